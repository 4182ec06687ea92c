"""The stored lexical index against plain scores: blocks, pruning, appends, padding, negative weights."""

from __future__ import annotations

import math
import random
import re
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.operators import lexical_index as lx
from ticketlake.operators import retrieval as rt
from ticketlake.session import checkpoint_dir

TOKEN = re.compile(r"\w+")


def plain(chunks, queries, kind, k, pad=True):
    toks = {i: Counter(TOKEN.findall((t or "").lower())) for i, t in chunks}
    n, size = len(toks), {i: sum(c.values()) for i, c in toks.items()}
    avg = sum(size.values()) / n
    df = Counter(w for c in toks.values() for w in c)
    idf = {w: math.log(n - f + .5) - math.log(f + .5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else .25 * mean for w, v in idf.items()}
    out = set()
    for qid, text in queries:
        q = Counter(TOKEN.findall((text or "").lower()))
        rows = []
        for i, c in toks.items():
            both = [w for w in q if w in c]
            if not both and not pad:
                continue
            if kind == lx.BM25:
                s = sum(q[w] * idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (.25 + .75 * size[i] / avg)) for w in both)
            else:
                s = sum(q[w] * c[w] for w in both) / max(1e-300, math.sqrt(sum(x * x for x in q.values()) * sum(x * x for x in c.values())))
            rows.append((-round(s, 9) + 0.0, -i if kind == lx.BM25 else i, i))
        out |= {(qid, i, r, round(-s, 6) + 0.0) for r, (s, _, i) in enumerate(sorted(rows)[:k])}
    return out


def corpus(n, seed=1):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}" for i in range(300)]
    text = [" ".join([*rng.choices(common, k=rng.randint(0, 30)), *rng.choices(rare, k=rng.randint(0, 6))]) for _ in range(n)]
    text[5] = text[9]
    return [(1000 + 3 * i, t) for i, t in enumerate(text)] + [(7, ""), (8, None)]


QUERIES = [(1, "c0 c1 c2 r5 r9 r9 unknown"), (2, "C3 c3 r17"), (3, ""), (4, None), (5, "unknown"), (6, "c0 c1 c2 c3 c4 c5 c6 c7"),
           (7, " ".join(f"r{i}" for i in range(0, 300, 11)) + " c1 c2 c3")]


def frames(spark, chunks):
    return (spark.createDataFrame(chunks, "chunk_id long, text string"),
            spark.createDataFrame(QUERIES, "query_id long, text string"))


def found(df):
    return {(r.query_id, r.chunk_id, r["rank"], round(r.score, 6) + 0.0) for r in df.collect()}


def path(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@pytest.mark.parametrize("block", [40, 4096])
@pytest.mark.parametrize("pad", [True, False])
def test_equals_plain_scores(spark, block, pad):
    chunks = corpus(400)
    c, q = frames(spark, chunks)
    index = lx.build_index(c, path(spark, f"lx-{block}-{pad}"), block_chunks=block)
    both = lx.search(q, index, (lx.BM25, lx.COSINE), 6, pad)
    for kind in (lx.BM25, lx.COSINE):
        assert found(both.where(F.col("kind") == kind)) == plain(chunks, QUERIES, kind, 6, pad)


def test_appended_index_equals_a_new_one(spark):
    chunks = corpus(300, 2)
    c, q = frames(spark, chunks)
    first = lx.build_index(c.where("chunk_id % 2 = 0"), path(spark, "lx-append"), block_chunks=50)
    both = lx.append_index(first, c.where("chunk_id % 2 = 1"), block_chunks=50)
    assert both.n_blocks > first.n_blocks
    assert found(lx.search(q, both, k=6)) == plain(chunks, QUERIES, lx.BM25, 6)
    fresh = lx.build_index(c, path(spark, "lx-fresh"))
    def rounded(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rounded(both.idf) == rounded(fresh.idf) and rounded(both.totals) == rounded(fresh.totals)


def test_negative_weights_rank_below_chunks_that_share_nothing(spark):
    chunks = [(1, "a b"), (2, "a b"), (3, "a b"), (4, "")]
    c, q = spark.createDataFrame(chunks, "chunk_id long, text string"), spark.createDataFrame([(1, "a")], "query_id long, text string")
    out = rt.bm25_topk(q, c, k=2).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == [4, 3] and out[0].score == 0 and out[1].score < 0


def test_all_scores_and_struct_ids(spark):
    chunks = corpus(120, 3)
    c, q = frames(spark, chunks)
    q2 = q.select(F.struct("query_id", F.lit(1).alias("no")).alias("query_id"), "text")
    got = rt.bm25_score(q2, rt.bm25_stats(c)).collect()
    want = plain(chunks, QUERIES, lx.BM25, 10 ** 6, pad=False)
    assert {(r.query_id.query_id, r.chunk_id, round(r.score, 6) + 0.0) for r in got} == {(a, b, s) for a, b, _, s in want}


def test_empty_corpus_and_no_queries(spark):
    c, q = frames(spark, corpus(30))
    assert rt.bm25_topk(q, c.limit(0)).count() == 0
    assert rt.bm25_topk(q.limit(0), c).count() == 0


def test_frequent_terms_score_only_what_can_reach_the_best():
    import pyarrow as pa
    rng = random.Random(7)
    n = 3000
    rows = [[f"c{j}" for j in range(6) for _ in range(rng.randint(0, 2))] + [f"r{rng.randint(0, 200)}" for _ in range(4)] for _ in range(n)]
    t = lx._pack(pa.table({"block": pa.array([0] * n, pa.int32()), "chunk_id": pa.array(range(n), pa.int64()),
                           "toks": pa.array(rows, pa.list_(pa.string()))}))
    row = {c: t.column(c).combine_chunks().flatten() for c in t.column_names if c != "block"}
    terms = row.pop("terms").to_pylist()
    block = lx._Block({c: v.to_numpy(zero_copy_only=False) for c, v in row.items()}, float(np.mean([len(r) for r in rows])), 1.5, 0.75)
    words = ["r3", "r50", "r77", "r101", "c0", "c1", "c2"]
    weights = [5.0, 5.0, 5.0, 5.0, 0.5, 0.5, 0.5]
    places = [terms.index(w) for w in words]
    some, scores, made = lx.score_block(block, lx.BM25, places, weights, 10, True)
    every, all_scores, whole = lx.score_block(block, lx.BM25, places, weights, None, True)
    best = sorted(zip(-all_scores, -every, strict=True))[:10]
    assert list(zip(-scores, -some, strict=True)) == best
    assert made * 10 <= n and whole == n
