"""Lexical and dense retrieval, fusion, reranking and the abstention gate.

Result tables are long format ``(query_id, chunk_id, rank, score, ...)``.
Every ranking carries an explicit tie-break so results are deterministic:

* BM25: score desc, chunk id desc (a reversed ascending argsort);
* dense / BoW cosine: score desc, chunk id asc (flat-index order);
* RRF: fused score desc, then first-seen order ``(list_no, rank)``;
* rerank: score desc, then fusion order.

Scores are rounded to ``ROUND`` places before ranking so that sums whose
addition order differs between partitions rank identically.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.functions.text import tokenize
from ticketlake.operators import lexical_index as lx
from ticketlake.operators import vector_blocks as vb
from ticketlake.operators.completions import ABSTAIN_RESPONSE_TEXT
from ticketlake.session import checkpoint_dir, cut_lineage

ROUND = 9
# BM25 (Okapi) parameters, RRF constant, pipeline sizes, gate threshold.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
RRF_K = 60
RECALL_TOP_K = 15
RRF_TOP_N = 30
FINAL_TOP_K = 3
GATE_THRESHOLD = 0.35
# Narrow rows that may be broadcast.
BROADCAST_ROWS = 1_000_000


def attach_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (corpus totals) to every row, as one scalar subquery."""
    cols = scalars.columns
    return (df.withColumn("_totals", scalars.select(F.struct(*cols)).scalar())
              .select(*df.columns, *[F.col(f"_totals.{c}").alias(c) for c in cols]))


# ---------------------------------------------------------------------------------
# K4-K6: BM25
# ---------------------------------------------------------------------------------

def bm25_stats(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text",
               epsilon: float = BM25_EPSILON) -> lx.LexicalIndex:
    """K4: a stored index of the chunks in the shared checkpoint folder."""
    path = f"{checkpoint_dir(chunks.sparkSession).rstrip('/')}/lexical-index-{uuid.uuid4().hex}"
    return lx.build_index(chunks, path, epsilon, id_col, text_col)


def bm25_score(queries: DataFrame, index: lx.LexicalIndex, qid: str = "query_id", text_col: str = "text",
               k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """K5: Okapi scores of every chunk that shares a term with the query."""
    return lx.search(queries, index, (lx.BM25,), None, qid=qid, text_col=text_col, k1=k1, b=b).drop("kind")


def _first(df: DataFrame, w, name: str, k: int) -> DataFrame:
    """0-based rank of the first k rows of each window; ``row_number() <= k`` is the form that
    Spark turns into a group limit before the shuffle."""
    return (df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
              .withColumn(name, F.col(name) - 1))


def bm25_topk(queries: DataFrame, chunks: DataFrame, index: lx.LexicalIndex | None = None, k: int = RECALL_TOP_K,
              qid: str = "query_id", text_col: str = "text", pad: bool = True) -> DataFrame:
    """K6: ``(query_id, chunk_id, rank, score)``, rank 0-based; ties: later chunk first.  With ``pad``
    chunks that share nothing with the query take part with score 0, as for a full-corpus scorer."""
    return lx.search(queries, index or bm25_stats(chunks), (lx.BM25,), k, pad, qid, text_col, BM25_K1, BM25_B).drop("kind")


def bow_cosine_topk(queries: DataFrame, chunks: DataFrame, k: int = RECALL_TOP_K, qid: str = "query_id",
                    text_col: str = "text", pad: bool = True, index: lx.LexicalIndex | None = None) -> DataFrame:
    """Inner product of length-1 term-count vectors (the dense retriever of the text pipeline) over the
    same index; ties: earlier chunk first, as a flat index returns them."""
    return lx.search(queries, index or bm25_stats(chunks), (lx.COSINE,), k, pad, qid, text_col).drop("kind")


# ---------------------------------------------------------------------------------
# K7-K9: vectors
# ---------------------------------------------------------------------------------

def l2_normalize(vec: Column) -> Column:
    """K7: ``v / ||v||`` (a zero vector stays zero)."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


# Vectors in a block, at least and at most; a pair of blocks is one bounded group, scored in strips of queries.
VECTOR_BLOCK, VECTOR_BLOCK_MOST, SIDE_BLOCKS, STRIP = 2048, 16_384, 8, 256
GROUP_BITS, GROUP_ROWS = 8, 131_072  # buckets of a group (as bits) and its rows, of either side


def _stored(df: DataFrame, vec_col: str) -> Column:
    floats = df.select(vec_col).schema[0].dataType.simpleString() == "array<float>"
    return F.col(vec_col) if floats else F.col(vec_col).cast("array<double>")


def _vectors(table) -> vb.Vectors:
    """The vectors ``(id, v)`` of a group, by ascending id."""
    import numpy as np
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return vb.Vectors(ids[order], vb.matrix(table.column("v"))[order])


def vector_block(n: int) -> int:
    """Vectors of a block: every vector goes to as many groups as the other side has blocks, so that blocks
    grow with the table once its pairs of blocks keep the cores busy."""
    return min(VECTOR_BLOCK_MOST, max(VECTOR_BLOCK, -(-n // SIDE_BLOCKS)))


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int = RECALL_TOP_K, id_col: str = "vec_id",
               vec_col: str = "embedding", query_id_col: str = "query_id", exclude_self: bool = False,
               block_rows: int | None = None) -> DataFrame:
    """K8: exact inner-product top-k of a stated query set against all vectors, in blocks.

    Both sides are dealt into blocks of about ``block_rows`` (``vector_block`` of their rows) by hashed id.
    Each pair of a query block and a corpus block is one group, scored strip by strip, and only its k
    best rows a query go on to the final ranking.  Vectors travel as they are stored.  A product in single
    precision chooses the pairs that become scores.  Nothing passes through the driver but the two row
    counts.  Ties: smaller id first.
    """
    n_q, n_c = queries.count(), corpus.count()
    q_blocks = max(1, -(-n_q // (block_rows or vector_block(n_q))))
    c_blocks = max(1, -(-n_c // (block_rows or vector_block(n_c))))

    q = (queries.select(F.col(query_id_col).cast("long").alias("id"), _stored(queries, vec_col).alias("v"))
         .withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int"))
         .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))))
    c = (corpus.select(F.col(id_col).cast("long").alias("id"), _stored(corpus, vec_col).alias("v"))
         .withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(c_blocks)).cast("int"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))

    def best(left, right):
        import pyarrow as pa
        qid, known = left.column("id").to_numpy(), _vectors(right)
        row, col, value = vb.best_pairs(vb.Vectors(qid, vb.matrix(left.column("v"))), known, k, exclude_self, strip=STRIP)
        return pa.table({"query_id": qid[row], "chunk_id": known.ids[col], "score": value})

    out = (q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb"))
           .applyInArrow(best, "query_id long, chunk_id long, score double"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    return _first(out, w, "rank", k)


def dense_topk_lsh(corpus: DataFrame, queries: DataFrame, k: int = RECALL_TOP_K, id_col: str = "vec_id",
                   vec_col: str = "embedding", query_id_col: str = "query_id", exclude_self: bool = False,
                   num_tables: int = 16, bucket_rows: int = 400, seed: int = 7) -> DataFrame:
    """K9: approximate top-k through random hyperplanes.

    A vector's side of some hyperplanes is its bucket in a table; the number of hyperplanes
    follows the corpus, so that buckets keep about ``bucket_rows`` vectors.  A query looks into
    its own bucket of each table and into those that one hyperplane parts from it; what it finds
    is scored exactly.  A query that finds fewer than k vectors is answered by ``dense_topk``.

    Buckets that agree in all but the last ``GROUP_BITS`` hyperplanes are one group, scored in blocks, so
    that candidates are never rows: a group hands on its k best a query.  Groups of more than ``GROUP_ROWS``
    rows of either side are dealt into parts by hashed id.
    """
    import math

    import numpy as np

    n = corpus.count()
    first = corpus.select(F.size(vec_col).alias("d")).first()
    planes = max(1, int(math.log2(max(2, n / bucket_rows))))
    dim = first["d"] if first else 1
    sides = np.random.default_rng(seed).normal(size=(num_tables * planes, dim))
    low = min(planes, GROUP_BITS)

    def coded(df, name):
        rows = df.select(F.col(name).cast("long").alias("id"), _stored(df, vec_col).alias("v")).where("v IS NOT NULL")

        def code(batches):
            import pyarrow as pa
            for b in batches:
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                bits = (v @ sides.T >= 0).reshape(b.num_rows, num_tables, planes).astype(np.int32) << np.arange(planes, dtype=np.int32)
                codes = pa.FixedSizeListArray.from_arrays(pa.array(bits.sum(axis=2, dtype=np.int32).ravel()), num_tables)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), codes.cast(pa.list_(pa.int32()))], names=["id", "v", "codes"])
        kind = rows.schema["v"].dataType.simpleString()
        return rows.mapInArrow(code, f"id long, v {kind}, codes array<int>").select("id", "v", F.posexplode("codes").alias("t", "b"))

    def grouped(rows, name):
        rows = rows.withColumn("g", F.shiftright("b", low))
        parts = rows.groupBy("t", "g").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias(name))  # a row a group
        return rows, cut_lineage(parts)
    far = F.array(F.lit(0), *[F.lit(1 << i) for i in range(low, planes)])  # looks into other groups
    qq, q_parts = grouped(coded(queries, query_id_col).withColumn("flip", F.explode(far))
                          .withColumn("b", F.col("b").bitwiseXOR(F.col("flip"))), "qn")
    cc, c_parts = grouped(coded(corpus, id_col), "cn")
    parts = q_parts.join(c_parts, ["t", "g"])  # groups that both sides have

    def dealt(rows, own, other, own_part, other_part):
        return (rows.join(F.broadcast(parts), ["t", "g"]).withColumn(own_part, F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
                .withColumn(other_part, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("qn", "cn"))
    key = ["t", "g", "qp", "cp"]
    near = [1 << i for i in range(low)]

    def best(left, right):
        import pyarrow as pa
        qid, own, flip = (left.column(x).to_numpy() for x in ("id", "b", "flip"))
        known = _vectors(right)
        code = right.column("b").to_numpy()[np.argsort(right.column("id").to_numpy(), kind="stable")]
        asked, parts = vb.Vectors(qid, vb.matrix(left.column("v"))), []
        for at, flips in ((np.flatnonzero(flip == 0), near), (np.flatnonzero(flip != 0), [])):
            row, col, value = vb.probe_buckets(asked.part(at), own[at], known, code, flips, k, exclude_self)
            parts.append(pa.table({"query_id": qid[at][row], "chunk_id": known.ids[col], "score": value}))
        return pa.concat_tables(parts)
    got = (dealt(qq, "qn", "cn", "qp", "cp").groupBy(*key).cogroup(dealt(cc, "cn", "qn", "cp", "qp").groupBy(*key))
           .applyInArrow(best, "query_id long, chunk_id long, score double"))
    # a pair that several tables find counts once; pairs are shuffled once
    scored = got.repartition("query_id").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    found = cut_lineage(_first(scored, w, "rank", k))
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
    rest = queries.join(enough, queries[query_id_col] == enough["query_id"], "left_anti")
    exact = dense_topk(corpus, rest, k, id_col, vec_col, query_id_col, exclude_self)
    return found.join(enough, "query_id", "left_semi").select("query_id", "chunk_id", "score", "rank").unionByName(
        exact.select("query_id", "chunk_id", "score", "rank"))


# ---------------------------------------------------------------------------------
# Fusion, rerank, two-stage
# ---------------------------------------------------------------------------------

def rrf_fusion(lists: DataFrame, k: int = RRF_K, top_n: int = RRF_TOP_N) -> DataFrame:
    """``sum 1/(k + rank + 1)`` per chunk over all lists of a query (rank 0-based),
    deduplicated by chunk; ties keep first-seen order; top ``top_n``."""
    agg = lists.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank") + 1)), ROUND).alias("rrf_score"),
        F.min(F.struct("list_no", "rank")).alias("first_seen"))
    w = Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), F.col("first_seen"))
    return _first(agg, w, "fusion_rank", top_n).drop("first_seen")


def lexical_overlap(query: Column, text: Column) -> Column:
    """Default rerank scorer: share of the query's distinct tokens found in the chunk."""
    q = F.array_distinct(tokenize(query))
    hit = F.size(F.array_intersect(q, F.array_distinct(tokenize(text))))
    return F.when(F.size(q) > 0, hit.cast("double") / F.size(q)).otherwise(F.lit(0.0))


def rerank_topk(candidates: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_overlap,
                k: int = FINAL_TOP_K, query_col: str = "query_text", text_col: str = "text") -> DataFrame:
    """Score ``(original query, chunk text)`` pairs, keep the top k; ties keep
    fusion order.  ``scorer`` is any Column function, e.g. a ``pandas_udf``."""
    scored = candidates.withColumn("rerank_score", F.round(scorer(F.col(query_col), F.col(text_col)), ROUND))
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("fusion_rank"))
    return _first(scored, w, "rank", k)


def with_chunk_meta(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    return ranked.join(chunks.select("chunk_id", "source", "text"), "chunk_id")


def two_stage_retrieve(queries: DataFrame, chunks: DataFrame, qid: str = "query_id", text_col: str = "text",
                       recall_k: int = RECALL_TOP_K, rrf_k: int = RRF_K, rrf_top_n: int = RRF_TOP_N,
                       final_k: int = FINAL_TOP_K, scorer: Callable[[Column, Column], Column] = lexical_overlap,
                       index: lx.LexicalIndex | None = None) -> DataFrame:
    """Per query text, a BM25 list and a cosine list -> RRF -> rerank.

    ``queries`` may hold several texts per query id (expansions) with a
    ``query_no``; lists are numbered ``2*query_no`` (BM25) and ``2*query_no+1``
    (cosine), matching the order in which the lists are produced.  The rerank
    always uses the original text (``query_no = 0``).  The index is read once for both lists.
    """
    q = queries.select(F.col(qid).alias("query_id"),
                       (F.col("query_no") if "query_no" in queries.columns else F.lit(0)).alias("query_no"),
                       F.col(text_col).alias("text"))
    sub = q.select(F.struct("query_id", "query_no").alias("query_id"), "text")
    found = lx.search(sub, index or bm25_stats(chunks), (lx.BM25, lx.COSINE), recall_k, k1=BM25_K1, b=BM25_B)
    lists = found.select(F.col("query_id.query_id").alias("query_id"),
                         (F.col("query_id.query_no") * 2 + F.col("kind")).alias("list_no"), "rank", "chunk_id")
    fused = rrf_fusion(lists, rrf_k, rrf_top_n)
    originals = q.where(F.col("query_no") == 0).select("query_id", F.col("text").alias("query_text"))
    few = queries.count() * rrf_top_n <= BROADCAST_ROWS  # then the chunks' texts are not shuffled
    cand = with_chunk_meta(F.broadcast(fused) if few else fused, chunks).join(originals, "query_id")
    return rerank_topk(cand, scorer, final_k).select(
        "query_id", "rank", "chunk_id", "source", "text", "rerank_score", "fusion_rank", "rrf_score")


# ---------------------------------------------------------------------------------
# Gate and records
# ---------------------------------------------------------------------------------

def has_text(text: Column) -> Column:
    """A ticket without text is not searched for."""
    return F.coalesce(F.trim(text), F.lit("")) != ""


def abstention_gate(queries: DataFrame, reranked: DataFrame, threshold: float = GATE_THRESHOLD,
                    qid: str = "query_id") -> DataFrame:
    """No chunks -> abstain (score 0, ``no_chunks_retrieved``); best score below
    the threshold -> abstain (``max_rerank_score_below_threshold``); else pass.
    Also carries the ranked sources for the record (K15-K17)."""
    per_q = reranked.groupBy("query_id").agg(
        F.max(F.coalesce(F.col("rerank_score"), F.lit(0.0))).alias("max_score"),
        F.count("*").alias("n_chunks"),
        F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("_src"))
    base = queries.select(F.col(qid).alias("query_id")).join(per_q, "query_id", "left")
    none = F.col("n_chunks").isNull()
    max_score = F.when(none, F.lit(0.0)).otherwise(F.col("max_score"))
    abstain = none | (max_score < threshold)
    reason = (F.when(none, "no_chunks_retrieved")
              .when(max_score < threshold, "max_rerank_score_below_threshold"))
    sources = F.coalesce(F.transform("_src", lambda s: F.coalesce(s["source"], F.lit(""))),
                         F.array().cast("array<string>"))
    return base.select("query_id", abstain.alias("should_abstain"), max_score.alias("max_score"),
                       reason.alias("reason"), sources.alias("sources"))


def gate_output(gated: DataFrame) -> DataFrame:
    """An abstaining query gets the fixed refusal, empty citations and its source
    list; a passing one only records the flag and the score."""
    a = F.col("should_abstain")
    return gated.select(
        "query_id", a.alias("abstain_flag"),
        F.when(a, F.lit(ABSTAIN_RESPONSE_TEXT)).alias("draft_response"),
        F.when(a, F.array().cast("array<int>")).alias("citations"),
        F.when(a, F.col("sources")).alias("top_3_sources"),
        F.col("max_score").alias("retrieval_max_score"))


def retrieval_fallbacks(state: DataFrame) -> DataFrame:
    """Sources from the chunks when unset; max score from the chunks when unset
    or 0; an empty ticket text abstains before retrieval."""
    empty = F.coalesce(F.trim(F.col("cleaned_text")), F.lit("")) == ""
    src = F.when(F.size(F.coalesce(F.col("top_3_sources"), F.array())) > 0, F.col("top_3_sources")).otherwise(
        F.coalesce(F.col("chunk_sources"), F.array().cast("array<string>")))
    ms = F.when(F.coalesce(F.col("retrieval_max_score"), F.lit(0.0)) != 0, F.col("retrieval_max_score")).otherwise(
        F.greatest(F.lit(0.0), F.coalesce(F.col("chunk_max_score"), F.lit(0.0))))
    return state.select(
        "*",
        F.when(empty, F.array().cast("array<string>")).otherwise(src).alias("final_sources"),
        F.when(empty, F.lit(0.0)).otherwise(ms).alias("final_max_score"),
        (empty | F.coalesce(F.col("abstain_flag"), F.lit(True))).alias("final_abstain"))


def join_pipe(arr: Column) -> Column:
    """A list column as a ``|``-joined string, in list order."""
    return F.array_join(F.transform(F.coalesce(arr, F.array()), lambda x: x.cast("string")), "|")


def cited_sources(df: DataFrame, sources_col: str = "top_3_retrieved_sources",
                  citations_col: str = "citations", key: str = "ticket_id") -> DataFrame:
    """One row per retrieved source with a ``cited`` flag."""
    cits = F.filter(F.split(F.coalesce(F.col(citations_col), F.lit("")), r"\|"), lambda x: x != "")
    return (df.where(F.coalesce(F.col(sources_col), F.lit("")) != "")
              .select(key, F.posexplode(F.split(F.col(sources_col), r"\|")).alias("idx", "source"), cits.alias("_c"))
              .select(key, "idx", "source", F.array_contains("_c", F.col("idx").cast("string")).alias("cited")))
