"""Quality score by hashed word n-grams and FTRL logistic regression (operator 6).

Words are normalised to themselves, to their shape (letter case and the marks around
them) and to whether they repeat the word before; n-grams are hashed into one weight vector.  A document's vector holds
log counts at unit length, and its score is the sigmoid of a sparse dot product.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import Memo, documents, id_text, labels, map_texts
from ticketlake.llm.ftrl import Ftrl, sigmoid

# The model is fitted on at most this many labelled rows, those whose hashed doc_id is smallest.
TRAIN_ROWS = 8_000
HASH_BITS = 18
# Passes over the sample: enough for this many updates, and at least LEAST_EPOCHS.
UPDATES, LEAST_EPOCHS = 32_000, 4
ALPHA = 0.5
THRESHOLD = 0.3
FOLDS, HELD_FOLD = 5, 0

WORD = re.compile(r"\w+").search
SHAPE_CELLS = 1 << 12


def _chunk(chunk: str) -> int:
    """Hash of the lower-cased word and hash of its shape, in one number."""
    m = WORD(chunk)
    if m is None:
        shape, word = "0" + chunk[:4], ""
    else:
        word = m.group()
        case = "A" if word.isupper() and len(word) > 1 else "Aa" if word[:1].isupper() else "a"
        shape = chunk[:m.start()][:4] + case + ("9" if word[-1:].isdigit() else "") + chunk[m.end():][:4]
    return zlib.crc32(word.lower().encode()) << 12 | zlib.crc32(shape.encode()) % SHAPE_CELLS


class Features:
    """Sparse n-gram vector of a text."""

    def __init__(self, bits: int = HASH_BITS, memo: int = 250_000):
        self.mask = np.uint64((1 << bits) - 1)
        self.of = Memo(_chunk, memo)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashed n-grams and values of unit length; both empty for a text without words."""
        chunks = text.split()
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(0)
        both = np.fromiter(map(self.of.__getitem__, chunks), dtype=np.uint64, count=len(chunks))
        word, shape = both >> np.uint64(12), both & np.uint64(SHAPE_CELLS - 1)
        grams = [_mix(word, 1), _mix(shape, 2), _mix(word[:-1] * np.uint64(1_000_003) + word[1:], 3),
                 _mix(shape[:-1] << np.uint64(12) | shape[1:], 4),
                 _mix(shape[:-2] << np.uint64(24) | shape[1:-1] << np.uint64(12) | shape[2:], 5),
                 _mix((word[1:] == word[:-1]).astype(np.uint64), 6)]
        ids, n = np.unique(np.concatenate(grams) & self.mask, return_counts=True)
        x = np.log1p(n)
        return ids.astype(np.int64), x / np.sqrt(x @ x)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fold_of(id_col, folds: int):
    """crc32 of the id as text, modulo ``folds`` (a null id: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, marks: DataFrame, label_col: str, rows: int, id_col: str = "doc_id",
                  text_col: str = "text", keep=None) -> DataFrame:
    """``(doc_id, text, y)``: at most ``rows`` rows, of labelled ids chosen by hash, with their texts.

    Null labels and ids are left out; an id labelled more than once counts as 1 if any row says so.
    Rows that repeat an id and its text count once; of several texts of an id each is a row, and the
    first ``rows`` rows stay.
    """
    ids = (marks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
           .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()))
    if keep is not None:
        ids = ids.where(keep)
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # copies meet in a task before the shuffle, so that one id may hold any share of the documents
    once = (id_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id")
            .groupBy("doc_id", "y", F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text")))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id", "sha").limit(rows).select("doc_id", "text", "y")


def fit_quality(train: DataFrame, bits: int = HASH_BITS) -> np.ndarray:
    """The weights, fitted in one task over the bounded sample, whose vectors many tasks make."""
    def vectors(batches):
        make = Features(bits)
        for b in batches:
            ids, texts, y = (b.column(i).to_pylist() for i in range(3))
            rows = [make(t) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "y": pa.array(y, pa.int32()),
                "ids": pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                "x": pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))})

    def fit(batches):
        rows, y = [], []
        for b in batches:
            rows += [(i.astype(np.int64), x.astype(float)) for i, x in
                     zip(_arrays(b.column("ids")), _arrays(b.column("x")), strict=True)]
            y += b.column("y").to_pylist()
        epochs = max(LEAST_EPOCHS, -(-UPDATES // max(1, len(rows))))
        w = Ftrl(1 << bits, alpha=ALPHA).fit(rows, y, epochs).weights()
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"i": pa.array(used), "w": pa.array(w[used])})

    sparse = (train.select("doc_id", "text", "y").mapInArrow(vectors, "doc_id long, y int, ids array<int>, x array<float>")
              .repartition(1).sortWithinPartitions("doc_id", "y").select("y", "ids", "x")
              .mapInArrow(fit, "i long, w double").toPandas())
    w = np.zeros((1 << bits) + 1)
    w[sparse["i"].to_numpy()] = sparse["w"].to_numpy()
    return w


def _arrays(column) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    at = at - at[0]
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)``: sparse dot products of whole texts; an empty text scores by the intercept alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        w, bits = shared.value, int(len(shared.value) - 1).bit_length() - 1
        vector = Features(bits)

        def run(ids, texts):
            out = []
            for t in texts:
                i, x = vector(t)
                out.append(float(w[i] @ x + w[-1]))
            return {"doc_id": ids, "score": sigmoid(np.array(out))}
        return run
    return map_texts(id_text(docs, id_col, text_col), make, "doc_id long, score double")


def quality(docs: DataFrame, marks: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row a document: ``doc_id, held_out, score, predicted``.

    Learns from labels of ids outside the held-out fold only (crc32 of the id modulo 5 is
    0); scores read nothing but the text.  Null and empty texts get the intercept's score;
    without any label all scores are 0.5.  Texts of any length are read whole.  Repeated rows
    each give a row, a null doc_id stays null and counts as held out, an empty table gives no
    rows; further columns are not looked at.
    """
    train = training_rows(docs, marks, "quality", train_rows, keep=fold_of(F.col("doc_id"), FOLDS) != HELD_FOLD)
    scored = score_quality(docs, fit_quality(train))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_FOLD).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op6_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), labels(spark, sf_dir))
