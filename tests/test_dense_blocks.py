"""Blocks of vectors grow with the table, and travel as they are stored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ticketlake.operators import retrieval as rt


def test_vectors_are_copied_to_few_blocks():
    assert rt.vector_block(500) == 2048 and -(-100_000 // rt.vector_block(100_000)) <= 8
    assert rt.vector_block(10**8) == 16_384  # a group stays bounded


def test_strips_and_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rt, "STRIP", 7)
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, size=(90, 6)).astype(np.float32) / 7
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    out = rt.dense_topk(df, df.select(F.col("vec_id").alias("query_id"), "embedding"), k=4, exclude_self=True, block_rows=40)
    assert "cast(embedding" not in out._jdf.queryExecution().optimizedPlan().toString()
    s = np.round(v.astype(np.float64) @ v.astype(np.float64).T, 9)
    np.fill_diagonal(s, -np.inf)
    want = {(i, int(j), rank) for i in range(90) for rank, j in enumerate(np.argsort(-s[i], kind="stable")[:4])}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in out.collect()} == want
