"""Relevance by containment, exact percentiles, bounded context lists, the knowledge-base excerpt, approximate search."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.operators import completions as cp
from ticketlake.operators import evaluate as ev
from ticketlake.operators import monitor as mo
from ticketlake.operators import retrieval as rt


def test_relevance_holds_chunks_that_no_run_has(spark):
    long = "one two three four five six seven eight nine ten"
    chunks = [(1, f"start {long} end"), (2, "ONE, two; three four five six seven eight nine"), (3, f"x{long}"), (4, "short text here"),
              (5, "a shorter textual here"), (6, None), (7, f"{long} {long}")]
    queries = [(10, long.title()), (11, "short text"), (12, ""), (13, None), (14, long)]
    c = spark.createDataFrame(chunks, "chunk_id long, text string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    labels = ev.containment_labels(q, c)
    assert sorted((r.query_id, r.chunk_id) for r in labels.collect()) == [(10, 1), (10, 7), (11, 4), (14, 1), (14, 7)]
    run = spark.createDataFrame([(10, 0, 1), (10, 1, 2), (11, 0, 5), (14, 0, 3), (14, 1, 7)], "query_id long, rank int, chunk_id long")
    relevant = labels.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    out = {r.query_id: (r.rr, round(r.ndcg, 6)) for r in ev.per_query_metrics(ev.relevance_join(run, labels), 3, relevant).collect()}
    best = 1 + 1 / np.log2(3)  # two relevant chunks
    assert out == {10: (1.0, round(1 / best, 6)), 11: (0.0, 0.0), 14: (0.5, round(1 / np.log2(3) / best, 6))}


@pytest.mark.parametrize("bins", [3, 1000])
def test_percentiles_equal_linear_interpolation(spark, bins):
    rng = random.Random(2)
    groups = {"a": [rng.random() * 9 for _ in range(301)], "b": [5.0] * 400 + [7.5, 1.25], "c": [3.0], "d": [1.0, 2.0],
              None: [rng.randint(0, 4) for _ in range(57)], "e": []}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("e", None), ("a", None)]
    out = mo.exact_percentile(spark.createDataFrame(rows, "k string, v double"), "k", "v", 0.95, "p", bins)
    got = {r.k: r.p for r in out.collect()}
    assert set(got) == set(groups) and got["e"] is None
    for k, vs in groups.items():
        if vs:
            assert abs(got[k] - np.quantile(vs, 0.95)) < 1e-9


def test_only_the_first_contexts_are_listed(spark):
    ctx = spark.createDataFrame([(1, i, f"c{i}") for i in range(50)] + [(2, 0, "only")], "ticket_id long, rank long, text string")
    ans = spark.createDataFrame([(1, False, "yes"), (2, False, "no"), (3, False, "none")], "ticket_id long, abstain_flag boolean, draft_response string")
    out = {r.ticket_id: r.contexts for r in ev.answer_eval_set(ans, ctx).collect()}
    assert out == {1: ["c0", "c1", "c2"], 2: ["only"], 3: []}
    plan = ev.answer_eval_set(ans, ctx)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    t = spark.createDataFrame([(1, "help")], "ticket_id long, ticket_text string")
    body = cp.build_answer_prompt(t, ctx, k=2).first().user_message
    assert "Source 1:\nc1" in body and "c2" not in body


def test_excerpt_reads_the_whole_knowledge_base(spark):
    docs = spark.createDataFrame([(3, "ccc"), (1, "a" * 4), (2, None), (4, "d" * 100)], "doc_id long, text string")
    assert cp.kb_excerpt(docs, 20).first().kb == "aaaa\n\n\n\nccc\n\nddddddd"
    assert cp.kb_excerpt(docs.limit(0), 20).first().kb == ""


def test_approximate_search_keeps_nine_tenths(spark):
    """On the registered vectors, with buckets small enough to matter."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    order = np.argsort(ids)
    ids, v = ids[order], v[order]
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    s = np.round(v @ v.T, 9)
    np.fill_diagonal(s, -np.inf)
    got = {(r.query_id, r.chunk_id) for r in rt.dense_topk_lsh(e, asked, k=15, exclude_self=True).collect()}
    want = {(int(ids[i]), int(ids[j])) for i in range(len(ids)) if ids[i] % 20 == 0 for j in np.argsort(-s[i], kind="stable")[:15]}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
