"""texts' terms, chunks and postings are not shuffled or written as rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tests.test_features import TEXTS, plain
from ticketlake.operators import lexical_index as lx
from ticketlake.operators import text_scores as ts
from ticketlake.session import checkpoint_dir


def test_labelled_sums_equal_the_weights_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(ts, "MAX_DF", 1.0)
    rows = [(i, t, "x" if i % 2 else None, "p" if i % 3 else "q") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "k long, t string, a string, b string").repartition(3)
    got = ts.labelled_sums(df.select("k", "t"), df, "t", ["a", "b"], 25)
    weights = plain(TEXTS, "word", True, ts.MIN_DF, 1.0, 25)
    for place, axis in ((2, "a"), (3, "b")):
        want = {}
        for (i, g), w in weights.items():
            if rows[i][place] is not None:
                want[rows[i][place], g] = want.get((rows[i][place], g), 0) + w
        assert {(r["class"], r.term): round(r.w, 6) for r in got[axis].collect()} == {k: round(w, 6) for k, w in want.items()}


def test_blocks_of_an_index_are_neither_built_nor_searched_by_a_shuffle(spark):
    c = spark.range(500).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", F.lit("red"), F.col("id") % 9, F.col("id") % 50).alias("text")).repartition(3)
    index = lx.build_index(c, f"{checkpoint_dir(spark)}/lx-{uuid.uuid4().hex}", block_chunks=64)
    assert index.n_blocks == index.blocks.select("block").distinct().count() >= 8
    q = spark.createDataFrame([(1, "red 3"), (2, "49")], "query_id long, text string")
    assert "Exchange" not in lx.search(q, index, k=None)._jdf.queryExecution().executedPlan().toString()
