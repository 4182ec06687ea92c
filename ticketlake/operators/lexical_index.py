"""Stored inverted index for lexical search (K4-K6 and the bag-of-words side of K12).

Chunks are dealt into blocks of a few thousand.  A block is one row: its chunk ids and lengths
and, for every term in it, the delta-coded numbers of the chunks that hold the term, their
counts, and bounds on what the term can add to a score there.  Building packs the chunks where they are
read and shuffles only the terms' counts; searching shuffles blocks and queries, never postings, and nothing
but the best chunks where the queries are one block.

A search pairs each block of queries with each block of chunks.  Within a pair, a query's
rarest terms choose the candidates: once the terms still to come cannot lift a chunk to the
k-th best, they only add to the chunks that can still get there.  Only the k best chunks of
a query leave a pair, so rows do not grow with the chunks that share a common word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake.functions.text import tokenize
from ticketlake.session import bound_batches

ROUND = 9
BLOCK_CHUNKS = 4096   # chunks of a block
BLOCK_QUERIES = 1024  # queries of a block
BM25, COSINE = 0, 1   # kinds of score

_BLOCK = ("block long, ids array<long>, lengths array<int>, norms array<double>, terms array<string>, starts array<int>, "
          "gaps array<int>, counts array<int>, top_count array<int>, low_length array<int>, top_share array<double>")


class LexicalIndex(NamedTuple):
    path: str
    blocks: DataFrame  # see _BLOCK
    idf: DataFrame     # term, df, idf
    totals: DataFrame  # n_docs, avgdl, mean_idf (one row)
    n_blocks: int
    generation: int    # appends so far


# ---------------------------------------------------------------------------------
# Building
# ---------------------------------------------------------------------------------

def _pack(t):
    """One block's row from its ``(block, chunk_id, toks)``."""
    import pyarrow as pa
    t = t.sort_by("chunk_id")
    toks = t.column("toks").combine_chunks()
    length = toks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = toks.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(length)
    pairs, count = np.unique(code * n + np.repeat(np.arange(n), length), return_counts=True)
    term, row = pairs // n, pairs % n
    starts = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
    norm = np.sqrt(np.bincount(row, weights=count.astype(float) ** 2, minlength=n))
    gaps = np.diff(row, prepend=0)
    gaps[starts[:-1]] = row[starts[:-1]]

    def each(op, values):
        return op.reduceat(values, starts[:-1]) if len(values) else values

    def cell(values, kind):
        return pa.array([pa.array(values, type=kind) if not isinstance(values, pa.Array) else values], type=pa.list_(kind))
    return pa.table({
        "block": pa.array([t.column("block")[0].as_py()], pa.int64()), "ids": cell(t.column("chunk_id").to_numpy(), pa.int64()),
        "lengths": cell(length, pa.int32()), "norms": cell(norm, pa.float64()), "terms": cell(coded.dictionary, pa.string()),
        "starts": cell(starts, pa.int32()), "gaps": cell(gaps, pa.int32()), "counts": cell(count, pa.int32()),
        "top_count": cell(each(np.maximum, count), pa.int32()), "low_length": cell(each(np.minimum, length[row]), pa.int32()),
        "top_share": cell(each(np.maximum, count / norm[row]), pa.float64())})


def _term_counts(batches):
    """Each block's terms with the number of its chunks that hold them."""
    import pyarrow as pa
    for b in batches:
        for terms, starts in zip(b.column("terms"), b.column("starts"), strict=True):
            yield pa.RecordBatch.from_arrays(
                [terms.values, pa.array(np.diff(starts.values.to_numpy()), type=pa.int64())], names=["term", "n"])


def _write_blocks(chunks: DataFrame, path: str, generation: int, block_chunks: int, id_col: str, text_col: str) -> int:
    """Adds the chunks' blocks and returns the number of all blocks.  A block holds rows that a task reads in a row."""
    spark = chunks.sparkSession
    toks = chunks.select(F.col(id_col).cast("long").alias("chunk_id"),
                         F.coalesce(tokenize(F.col(text_col)), F.array().cast("array<string>")).alias("toks"))

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        block, held, rows = (generation << 52) + (TaskContext.get().partitionId() << 26), [], 0

        def packed():
            t = pa.Table.from_batches(held)
            return _pack(t.append_column("block", pa.array(np.full(t.num_rows, block)))).to_batches()
        for b in batches:
            while b.num_rows:
                part = b.slice(0, block_chunks - rows)
                held.append(part)
                rows, b = rows + part.num_rows, b.slice(part.num_rows)
                if rows == block_chunks:
                    yield from packed()
                    block, held, rows = block + 1, [], 0
        if rows:
            yield from packed()
    bound_batches(spark)
    toks.mapInArrow(pack, _BLOCK).write.mode("append").option("compression", "zstd").parquet(f"{path}/blocks")
    return spark.read.schema(_BLOCK).parquet(f"{path}/blocks").count()


def _open(spark: SparkSession, path: str, n_blocks: int, generation: int, epsilon: float) -> LexicalIndex:
    """Writes the corpus statistics of all blocks and returns the index."""
    from ticketlake.operators.retrieval import attach_scalars
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    df = (blocks.select("terms", "starts").mapInArrow(_term_counts, "term string, n long")
          .groupBy("term").agg(F.sum("n").alias("df")))
    sizes = blocks.agg(F.sum(F.size("ids")).cast("long").alias("n_docs"),
                       F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("_tokens"))
    sizes.select(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), (F.col("_tokens") / F.nullif(F.col("n_docs"), F.lit(0))).alias("avgdl")
                 ).write.parquet(f"{path}/sizes-{generation}")
    sizes = spark.read.parquet(f"{path}/sizes-{generation}")
    attach_scalars(df, sizes.select("n_docs")).select(
        "term", "df", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf_raw")
    ).write.parquet(f"{path}/terms-{generation}")
    raw = spark.read.parquet(f"{path}/terms-{generation}")
    mean = raw.agg(F.avg("idf_raw").alias("mean_idf"))
    idf = attach_scalars(raw, mean).select("term", "df", F.when(F.col("idf_raw") < 0, F.lit(epsilon) * F.col("mean_idf"))
                                           .otherwise(F.col("idf_raw")).alias("idf"))
    return LexicalIndex(path, blocks, idf, attach_scalars(sizes, mean), n_blocks, generation)


def build_index(chunks: DataFrame, path: str, epsilon: float = 0.25, id_col: str = "chunk_id", text_col: str = "text",
                block_chunks: int = BLOCK_CHUNKS) -> LexicalIndex:
    """K4: stores the index of ``chunks`` under ``path``; ``idf`` holds document frequencies and Okapi
    idf ``ln(N - df + 0.5) - ln(df + 0.5)``, negative values raised to ``epsilon`` times the mean."""
    n = _write_blocks(chunks, path, 0, block_chunks, id_col, text_col)
    return _open(chunks.sparkSession, path, n, 0, epsilon)


def append_index(index: LexicalIndex, chunks: DataFrame, epsilon: float = 0.25, id_col: str = "chunk_id",
                 text_col: str = "text", block_chunks: int = BLOCK_CHUNKS) -> LexicalIndex:
    """The index with more chunks: their blocks are added, the others are not written again."""
    n = _write_blocks(chunks, index.path, index.generation + 1, block_chunks, id_col, text_col)
    return _open(chunks.sparkSession, index.path, n, index.generation + 1, epsilon)


# ---------------------------------------------------------------------------------
# Scoring one block
# ---------------------------------------------------------------------------------

class _Block:
    """A block's arrays, with each asked term's postings decoded once."""

    def __init__(self, row: dict, avgdl: float | None, k1: float, b: float):
        self.ids, self.row, self.k1 = row["ids"], row, k1
        self.norm = row["norms"]
        self.slow = k1 * (1 - b + b * row["lengths"] / avgdl) if avgdl else np.zeros(len(self.ids))
        least = k1 * (1 - b + b * row["low_length"] / avgdl) if avgdl else np.zeros(len(row["low_length"]))
        self.bounds = (row["top_count"] * (k1 + 1) / (row["top_count"] + least), row["top_share"])
        self.seen: dict[int, tuple] = {}

    def postings(self, at: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        got = self.seen.get(at)
        if got is None:
            a, z = self.row["starts"][at], self.row["starts"][at + 1]
            rows, count = np.cumsum(self.row["gaps"][a:z]), self.row["counts"][a:z]
            got = self.seen[at] = (rows, (count * (self.k1 + 1) / (count + self.slow[rows]), count / self.norm[rows]))
        return got


def score_block(block: _Block, kind: int, places: list[int], weights: list[float], k: int | None,
                pad: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and scores of the query's best ``k`` chunks of a block (None: all that share a term with it),
    and the number of chunks whose whole score was made.

    ``places`` and ``weights``: the query's terms in this block.  With ``pad`` chunks that share
    nothing with the query take part with score 0.
    """
    n, score, matched = len(block.ids), np.zeros(len(block.ids)), None
    order = sorted(range(len(places)), key=lambda i: block.row["starts"][places[i] + 1] - block.row["starts"][places[i]])
    bound = [weights[i] * block.bounds[kind][places[i]] for i in order]
    left = np.cumsum([0.0, *bound[::-1]])[::-1]  # what the terms from i on can add
    if not pad or k is None:
        matched = np.zeros(n, dtype=bool)
    whole = np.arange(n)  # chunks that can still be among the k best
    prune = k is not None and min(weights, default=0.0) >= 0
    gate = left[0] / 2
    for step, i in enumerate(order):
        if prune and left[step] <= gate and len(whole) > k:
            # rarer terms are in: the others only score what can still reach the k-th best
            gate = left[step] / 2
            sums = score[whole]
            kth = np.partition(sums, len(sums) - k)[len(sums) - k]
            whole = whole[sums + left[step] >= kth - 10.0 ** -(ROUND - 1)]
        rows, parts = block.postings(places[i])
        if len(whole) == n:
            score[rows] += weights[i] * parts[kind]
            hits = rows
        else:
            at = np.searchsorted(rows, whole)
            at[at == len(rows)] = 0
            found = rows[at] == whole
            hits = whole[found]
            score[hits] += weights[i] * parts[kind][at[found]]
        if matched is not None:
            matched[hits] = True
    score = np.round(score, ROUND)
    made = len(whole)
    if matched is not None:
        whole = whole[matched[whole]]
    if k is not None and len(whole) > k:
        values = score[whole]
        whole = whole[values >= np.partition(values, len(values) - k)[len(values) - k]]
        # ties: BM25 the later id, cosine the earlier one; rows ascend by id
        tie = -whole if kind == BM25 else whole
        whole = whole[np.lexsort((tie, -score[whole]))[:k]]
    return whole, score[whole], made


# ---------------------------------------------------------------------------------
# Searching
# ---------------------------------------------------------------------------------

def _query_rows(queries: DataFrame, index: LexicalIndex, qid: str, text_col: str) -> DataFrame:
    """``query_id, norm, entries``: each query's distinct terms with their counts and idf (null: not in the corpus)."""
    q = queries.select(F.col(qid).alias("query_id"), tokenize(F.col(text_col)).alias("toks"))
    terms = q.select("query_id", F.explode("toks").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    entries = (terms.join(index.idf.select("term", "idf"), "term", "left").groupBy("query_id")  # as many as a query has words
               .agg(F.collect_list(F.struct("term", F.col("qtf").cast("double").alias("qtf"), "idf")).alias("entries"),
                    F.sqrt(F.sum(F.col("qtf") * F.col("qtf"))).alias("norm")))
    return q.select("query_id").distinct().join(entries, "query_id", "left")


def search(queries: DataFrame, index: LexicalIndex, kinds: tuple[int, ...] = (BM25,), k: int | None = 15, pad: bool = True,
           qid: str = "query_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(query_id, kind, chunk_id, score[, rank])`` of every query: its ``k`` best chunks for each kind of score,
    rank 0-based; with ``k`` None all chunks that share a term with it, without ranks.

    Scores are rounded to ``ROUND`` places before ranking.  Ties: BM25 later chunk first, cosine
    earlier chunk first.
    """
    from ticketlake.operators.retrieval import attach_scalars
    rows = attach_scalars(_query_rows(queries, index, qid, text_col), index.totals.select("avgdl"))
    q_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))

    def best(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc
        at, kind_of, ids, scores = [], [], [], []
        if left.num_rows and right.num_rows:
            row = {name: right.column(name).combine_chunks().flatten() for name in right.column_names if name not in ("block", "qb")}
            vocabulary = row.pop("terms")
            block = _Block({n: v.to_numpy(zero_copy_only=False) for n, v in row.items()}, left.column("avgdl")[0].as_py(), k1, b)
            entries = left.column("entries").combine_chunks()
            flat = entries.flatten()
            places = pc.fill_null(pc.index_in(flat.field("term"), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            qtf = flat.field("qtf").to_numpy(zero_copy_only=False)
            idf = pc.fill_null(flat.field("idf"), 0.0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.fill_null(entries.value_lengths(), 0).to_numpy(zero_copy_only=False))
            norm = pc.fill_null(left.column("norm").combine_chunks(), 1.0).to_numpy(zero_copy_only=False)
            for i, z in enumerate(ends):
                own = np.arange(ends[i - 1] if i else 0, z)
                own = own[places[own] >= 0]
                for kind in kinds:
                    weights = qtf[own] * idf[own] if kind == BM25 else qtf[own] / norm[i]
                    found, values, _ = score_block(block, kind, places[own].tolist(), weights.tolist(), k, pad)
                    at.append(np.full(len(found), i))
                    kind_of.append(np.full(len(found), kind, np.int32))
                    ids.append(block.ids[found])
                    scores.append(values)
        take = np.concatenate([np.zeros(0, np.int64), *at])
        return pa.table({"query_id": left.column("query_id").take(pa.array(take, pa.int64())),
                         "kind": pa.array(np.concatenate([np.zeros(0, np.int32), *kind_of]), pa.int32()),
                         "chunk_id": pa.array(np.concatenate([np.zeros(0, np.int64), *ids]), pa.int64()),
                         "score": pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())})
    schema = T.StructType([T.StructField("query_id", rows.schema["query_id"].dataType), T.StructField("kind", T.IntegerType()),
                           T.StructField("chunk_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if q_blocks == 1:  # bounded: they go to every block
        asked = rows.sparkSession.sparkContext.broadcast(rows.toArrow())

        def each(batches):
            import pyarrow as pa
            for b in batches:
                for i in range(b.num_rows):
                    yield from best(asked.value, pa.Table.from_batches([b.slice(i, 1)])).to_batches()
        bound_batches(rows.sparkSession)
        out = index.blocks.mapInArrow(each, schema)
    else:
        q = (rows.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))
             .crossJoin(F.broadcast(index.blocks.select("block"))))  # a number a block
        c = index.blocks.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        out = q.groupBy("block", "qb").cogroup(c.groupBy("block", "qb")).applyInArrow(best, schema)
    if k is None:
        return out
    tie = F.when(F.col("kind") == BM25, -F.col("chunk_id")).otherwise(F.col("chunk_id"))
    w = Window.partitionBy("query_id", "kind").orderBy(F.col("score").desc(), tie)
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank") - 1)
