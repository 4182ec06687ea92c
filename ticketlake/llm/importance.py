"""Importance resampling toward a target distribution (operator 12).

Hashed word n-gram counts of the raw and of the target texts give every bucket a gain; a
text's weight is the sum of the gains of its features, looked up in an array.  Weights with
hashed Gumbel noise are scores, and the best share of the texts is drawn.  The last of the
drawn keys is found by a distributed quickselect, so only drawn rows are sorted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlake.llm.common import benchmark, documents, id_text, map_texts, slices, stage

BUCKETS = 10_000
LONGEST = 3  # words in a feature
# Bytes of one text that are cut into words at a time.
PIECE = 1 << 20
# Random pivots of one selection round; winners that one task ranks; copies of a row that one list numbers.
PIVOTS = 15
RANK_ROWS = 100_000
COPIES = 10_000

# Digits, ASCII letters in lower case and all bytes of other characters stay; the rest parts words.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                    for b in range(256))


# ---------------------------------------------------------------------------------
# Features of a text
# ---------------------------------------------------------------------------------

def word_lists(text: str, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The text's words in UTF-8, in lists that cover about ``piece`` bytes each."""
    data, at = text.encode().translate(_WORD_BYTES), 0
    while at < len(data):
        end = data.find(b" ", at + piece)
        end = len(data) if end < 0 else end
        if words := data[at:end].split():
            yield words
        at = end


def feature_hashes(lists: Iterable[list[bytes]], longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray]]:
    """``(words, crc32 of all features that end in these words)`` list by list.

    The checksum of a run goes on from that of the run one word shorter, so no run is spelled out;
    checksums of the runs that end in the last word are handed to the next list.
    """
    carry: list[int | None] = [None] * (longest - 1)  # of runs of 1, 2, ... words that end in the word before
    for words in lists:
        spaced = [b" " + w for w in words]
        level = [crc32(w) for w in words]
        out, first = [level], 0  # first: the word in which the level's first run ends
        for n, before in enumerate(carry):
            if before is not None:
                prior, start = [before, *level], 0
            else:
                prior, start = level, first + 1
            carry[n] = level[-1] if level else None
            level, first = [crc32(w, c) for w, c in zip(spaced[start:], prior, strict=False)], start
            out.append(level)
        yield len(words), np.array([c for x in out for c in x], dtype=np.int64)


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, n)`` over all texts; a task hands on one sum a bucket."""
    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for part in slices(b):
                for t in part.column(0).to_pylist():
                    for _, hashes in feature_hashes(word_lists(t)):
                        total += np.bincount(hashes % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})
    return (texts.select("text").mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket, ``floor(1000 ln of smoothed target share / smoothed raw share)``; ``buckets`` numbers."""
    both = (raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
            .unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))))
    s, t = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    odds = ((t + 1.0) * float(s.sum() + buckets)) / ((s + 1.0) * float(t.sum() + buckets))
    return np.floor(1000 * np.log(odds)).astype(np.int64)


def score_texts(texts: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score``."""
    shared = texts.sparkSession.sparkContext.broadcast(gain)

    def make():
        table = shared.value

        def f(ids, rows):
            out = np.zeros((3, len(rows)), dtype=np.int64)
            for i, t in enumerate(rows):
                for n, hashes in feature_hashes(word_lists(t)):
                    out[:, i] += n, len(hashes), table[hashes % len(table)].sum()
            return {"doc_id": ids, "n_words": out[0], "n_features": out[1], "weight": out[2]}
        return f
    rows = map_texts(texts, make, "doc_id long, n_words long, n_features long, weight long")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + noise)


# ---------------------------------------------------------------------------------
# Distributed selection
# ---------------------------------------------------------------------------------

def _literal(key: tuple) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(f"k{i}") for i, v in enumerate(key)])


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS, seed: int = 0) -> tuple | None:
    """The k-th smallest ``key`` (a struct of longs) of a staged table, from 1; None beyond its end.

    Every round draws random pivots among the keys still in question, each distinct key with the
    same chance, counts the rows below, at and between them in one pass, and goes on between two.
    """
    low = high = None
    below, turn = 0, 0
    while True:
        turn += 1
        open_rows = rows
        if low is not None:
            open_rows = open_rows.where(F.col("key") > _literal(low))
        if high is not None:
            open_rows = open_rows.where(F.col("key") < _literal(high))
        drawn = F.xxhash64("key", F.lit(seed), F.lit(turn))
        got = (open_rows.groupBy(F.pmod(drawn, F.lit(pivots)).alias("_group"))
               .agg(F.min_by("key", F.xxhash64(drawn, F.lit(turn))).alias("key")).collect())
        keys = sorted({tuple(r["key"]) for r in got})
        if not keys:
            return None
        # 2 i: between the pivots i - 1 and i; 2 i + 1: equal to pivot i
        place = sum(((F.col("key") > _literal(p)).cast("int") + (F.col("key") >= _literal(p)).cast("int") for p in keys), F.lit(0))
        counts = dict(open_rows.groupBy(place.alias("_place")).agg(F.count("*").alias("n")).collect())
        for at in range(2 * len(keys) + 1):
            n = counts.get(at, 0)
            if below + n >= k:
                break
            below += n
        else:
            return None
        if at % 2:
            return keys[at // 2]
        low = keys[at // 2 - 1] if at else low
        high = keys[at // 2] if at // 2 < len(keys) else high


def rank_rows(rows: DataFrame, count: int, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, ... by ``key``: sorted in ranges, each with the number of rows before it.

    Equal rows are counted first and numbered afterwards, so any number of them can share a key.
    """
    names = [c for c in rows.columns if c != "key"]
    once = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    parts = max(1, -(-count // rank_rows))
    dealt = stage(once.repartitionByRange(parts, "key").withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (dealt.join(F.broadcast(before), "_part")  # one row a part
              .withColumn("_first", F.col("_before") + F.sum("_n").over(inside) - F.col("_n") + 1))
    lists = placed.withColumn("_list", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.lit(COPIES)))))
    start = F.col("_list") * F.lit(COPIES)
    return lists.select(*names, F.explode(F.sequence(F.col("_first") + start,
                                                     F.col("_first") + F.least(start + F.lit(COPIES), F.col("_n")) - 1)).alias("rank"))


# ---------------------------------------------------------------------------------
# Operator
# ---------------------------------------------------------------------------------

def importance_draw(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42,
                    buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text",
                    target_text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_features, weight, score, rank``; rank is null where it is not drawn.

    Of the N documents of at least ``min_words`` words the ``floor(percent N / 100)`` with the highest
    scores are drawn, ties to the smaller doc_id, null ids last; of rows that agree in both, those with
    fewer features come first, and rows equal in all that are told apart by rank only.  Null texts
    have no words; texts of any length are read piece by piece.  An empty target has no counts, only
    smoothing; an empty table gives no rows.  Further columns are not looked at.
    """
    texts = id_text(docs, id_col, text_col)
    wanted = id_text(target.select(F.lit(0).alias("doc_id"), F.col(target_text_col).alias("text")))
    gain = gains(bucket_counts(texts, buckets), bucket_counts(wanted, buckets), buckets)
    key = F.struct(*[c.cast("long").alias(f"k{i}") for i, c in enumerate([
        -F.col("score"), F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("n_features")])])
    scored = stage(score_texts(texts, gain, seed).withColumn("key", key))
    enough = F.col("n_words") >= F.lit(min_words)
    keys = scored.where(enough).select("key")
    k = percent * keys.count() // 100
    columns = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    last = kth_key(keys, k) if k else None
    if last is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    won = enough & (F.col("key") <= _literal(last))
    drawn = rank_rows(scored.where(won).select("key", *columns), k)
    return (scored.where(~won).select(*columns, F.lit(None).cast("long").alias("rank"))
            .unionByName(drawn.withColumn("rank", F.when(F.col("rank") <= F.lit(k), F.col("rank")))))


def op12_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_draw(documents(spark, sf_dir), benchmark(spark, sf_dir))
