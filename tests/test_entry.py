"""Driver contract: entry(), the registry, and a sample of oracle parity at sf0.001."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_registry_shapes():
    qs, sqls = E.queries(), E.oracle_sql()
    assert len(qs) >= 100
    assert set(sqls) <= set(qs)
    assert all(callable(f) for f in qs.values())


def test_loads_without_the_corpus_operators(tmp_path):
    """The other queries load when the corpus operators' folders are gone, with or without the pipeline's file."""
    root = os.path.dirname(os.path.abspath(E.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) >= 100 and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(s) <= set(q)"
    for _ in range(2):
        done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, timeout=200,
                              env={**os.environ, "PYTHONPATH": str(copy)})
        assert done.returncode == 0, done.stderr[-800:]
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)


def test_failures_of_a_scorer_are_rows(spark):
    from ticketlake.operators.sources_ops import score_rows

    def scorer(row):
        if row["x"] == 2:
            raise ValueError("no such label")
        return {"predicted_category": str(10 // row["x"]), "tier_used": "model"}
    df = spark.createDataFrame([(1,), (2,), (0,), (None,)], "x int")
    out = {r.x: r for r in score_rows(df, scorer, "predicted_category string, tier_used string, draft_response string, confidence_score double").collect()}
    assert out[1].predicted_category == "10" and out[1].draft_response is None
    assert out[2].draft_response == "Error: no such label" and out[2].tier_used == "error" and out[2].confidence_score == 0.0
    assert out[0].draft_response.startswith("Error: ") and out[None].draft_response.startswith("Error: ")


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["ticket_id", "predicted_category", "predicted_priority"]


@pytest.mark.parametrize("name", ["scrub_text", "escalate_chain", "parse_prediction", "bm25_topk",
                                  "cost_by_component", "tier3_rate_hourly", "stratified_split"])
def test_oracle_parity_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(sdf.columns)

    def norm(rows, names):
        idx = sorted(range(len(names)), key=lambda i: names[i])
        out = []
        for r in rows:
            out.append(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in idx))
        return sorted(out, key=repr)

    assert norm([tuple(r) for r in sdf.collect()], sdf.columns) == norm(res.fetchall(), cols)
