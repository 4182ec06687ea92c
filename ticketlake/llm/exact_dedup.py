"""Exact duplicates through counting quotient filters (operator 2).

A 64-bit fingerprint is cut into a quotient (its place) and a remainder (what is stored).
Each partition builds filters of its own fingerprints, one for each range of quotients
(segment).  Within a filter the remainders lie sorted by quotient, so filters of the same
segment merge without loss: their sorted entries are merged and the counts added.  A
fingerprint whose merged count is one belongs to a unique text; texts of all others are
compared byte by byte.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import documents, id_text, slices, small_side, stage

# Fingerprints a task sorts at a time, and the mean number of them in a merged segment.
FILTER_ROWS = 1_000_000
SEGMENT_ROWS = 200_000


# ---------------------------------------------------------------------------------
# One filter
# ---------------------------------------------------------------------------------

def pack_filter(prints: np.ndarray, counts: np.ndarray, seg_bits: int) -> bytes:
    """Quotient filter of sorted distinct fingerprints that share their first ``seg_bits`` bits.

    Parts: one bit a quotient (occupied), one bit an entry (last of its quotient), the
    remainders in whole bytes, and the counts, one byte each with an overflow list.
    """
    n = len(prints)
    q = min(max(1, int(n - 1).bit_length()), 64 - seg_bits)
    r = 64 - seg_bits - q
    quotient = ((prints >> np.uint64(r)) & np.uint64((1 << q) - 1)).astype(np.int64)
    occupied = np.zeros(1 << q, dtype=bool)
    occupied[quotient] = True
    last = np.append(quotient[1:] != quotient[:-1], True)
    width = -(-r // 8)
    rest = (prints & np.uint64((1 << r) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    large = np.flatnonzero(counts >= 255)
    return b"".join([struct.pack("<iiii", n, q, seg_bits, len(large)), np.packbits(occupied).tobytes(),
                     np.packbits(last).tobytes(), np.ascontiguousarray(rest).tobytes(),
                     np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes()])


def unpack_filter(blob: bytes, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints and counts that ``pack_filter`` got."""
    n, q, seg_bits, many = struct.unpack_from("<iiii", blob)
    r = 64 - seg_bits - q
    at = 16
    occupied = np.unpackbits(np.frombuffer(blob, np.uint8, -(-(1 << q) // 8), at))[:1 << q]
    at += -(-(1 << q) // 8)
    last = np.unpackbits(np.frombuffer(blob, np.uint8, -(-n // 8), at))[:n]
    at += -(-n // 8)
    width = -(-r // 8)
    rest = np.zeros((n, 8), dtype=np.uint8)
    rest[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    counts = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
    at += n
    counts[counts == 255] = np.frombuffer(blob, "<i8", many, at)
    run = np.concatenate([[0], np.cumsum(last)[:-1]]).astype(np.int64)  # which occupied quotient an entry is of
    quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
    prints = quotient << np.uint64(r) | rest.view("<u8").ravel()
    if seg_bits:
        prints |= np.uint64(segment << (64 - seg_bits))
    return prints, counts


def add_up(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints with their counts summed."""
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.int64)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


# ---------------------------------------------------------------------------------
# Filters as a table
# ---------------------------------------------------------------------------------

def segment_bits(rows: int) -> int:
    """Bits of the fingerprint that choose a segment, so that segments keep their size as the rows grow."""
    return max(4, int(max(1, rows) // SEGMENT_ROWS).bit_length() + 2)


def build_filters(prints: DataFrame, seg_bits: int, col: str = "fp") -> DataFrame:
    """``(segment, filter)``: filters of each partition's own fingerprints."""
    def run(batches):
        held: list[np.ndarray] = []

        def rows():
            x, n = np.unique(np.concatenate(held), return_counts=True)
            seg = (x >> np.uint64(64 - seg_bits)).astype(np.int64)
            cut = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            ends = np.append(cut[1:], len(x))
            return pa.RecordBatch.from_pydict({
                "segment": pa.array(seg[cut]),
                "filter": pa.array([pack_filter(x[a:b], n[a:b], seg_bits) for a, b in zip(cut, ends, strict=True)],
                                   type=pa.binary())})
        for b in batches:
            if b.num_rows:
                held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= FILTER_ROWS:
                yield rows()
                held = []
        if held:
            yield rows()
    return prints.select(F.col(col).cast("long")).mapInArrow(run, "segment long, filter binary")


def merge_filters(filters: DataFrame) -> DataFrame:
    """``(segment, filter)``: one merged filter a segment.  A group is one segment's filters;
    copies are counts in them, so a fingerprint that many rows share adds nothing."""
    def run(table: pa.Table) -> pa.Table:
        segment = table.column("segment")[0].as_py()
        parts = [unpack_filter(b, segment) for b in table.column("filter").to_pylist()]
        x, n = add_up(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))
        seg_bits = struct.unpack_from("<iiii", table.column("filter")[0].as_py())[2]
        return pa.table({"segment": pa.array([segment], pa.int64()),
                         "filter": pa.array([pack_filter(x, n, seg_bits)], pa.binary())})
    return filters.groupBy("segment").applyInArrow(run, "segment long, filter binary")


def repeated(filters: DataFrame) -> DataFrame:
    """``(fp, n)``: fingerprints whose count is above one."""
    def run(batches):
        for b in batches:
            for part in slices(b, 8):
                for seg, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    x, n = unpack_filter(blob, seg)
                    hit = n > 1
                    yield pa.RecordBatch.from_pydict({"fp": pa.array(x[hit].view(np.int64)), "n": pa.array(n[hit])})
    return filters.select("segment", "filter").mapInArrow(run, "fp long, n long")


# ---------------------------------------------------------------------------------
# Operator
# ---------------------------------------------------------------------------------

def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document, dropped ones too: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; null counts as empty, so null and empty texts are
    one group.  The largest doc_id of a group stays.  Rows that repeat a doc_id and its text
    are the same document: each gives a row, all count in ``group_size``, and all of the
    largest doc_id say ``kept``.  A null doc_id stays only where its group has no other.
    Texts of any length are compared whole.  Further columns are not looked at; an empty table
    gives no rows.
    """
    texts = id_text(docs, id_col, text_col)
    marks = stage(texts.select("doc_id", F.xxhash64("text").alias("fp"), F.unhex(F.sha2("text", 256)).alias("sha")))
    filters = merge_filters(build_filters(marks.select("fp"), segment_bits(marks.count())))
    dup = stage(repeated(filters).select("fp"))

    # only texts whose fingerprint repeats are compared; copies meet in a task before the shuffle
    suspects = texts.withColumn("fp", F.xxhash64("text")).join(small_side(dup), "fp", "left_semi")
    groups = (suspects.groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
              .select("fp", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size"))
    out = marks.join(groups, ["fp", "sha"], "left")
    found = F.col("group_size").isNotNull()
    keep = F.when(found, F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
