"""Toxicity by a classifier chain (operator 9).

Categories are predicted one after the other.  Each is a linear model over hashed words and
word beginnings whose input also holds the probabilities of all earlier categories.  While
the chain is trained, those probabilities come from models that did not see the row (out of
fold), as they will when new rows are scored.

Categories, in order: ``profane`` (holds a term that is far commoner in toxic training rows),
``toxic`` (the label) and ``severe`` (toxic, with several such terms).
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ticketlake.llm.common import Memo, documents, id_text, labels, map_texts, worker_state
from ticketlake.llm.ftrl import Ftrl, sigmoid
from ticketlake.llm.quality import _arrays, training_rows

# The chain is fitted on at most this many labelled rows, those whose hashed doc_id is smallest.
TRAIN_ROWS = 8_000
HASH_BITS = 18
# Passes over the sample: enough for this many updates, and at least LEAST_EPOCHS.
UPDATES, LEAST_EPOCHS = 12_000, 2
CHAIN_FOLDS = 4
CATEGORIES = ("profane", "toxic", "severe")
THRESHOLD = 0.25
# A term marks profanity if rows that hold it are toxic at least this often, and enough of them are.
MARKER_SHARE, MARKER_ROWS = 0.9, 10
SEVERE_TERMS = 3
BEGINNINGS = (4, 5, 6)

WORDS = re.compile(r"[^\W\d_]+").findall


# Chunks whose cells a worker remembers (in two generations).
MEMO_CHUNKS = 100_000


def cells(chunk: str, bits: int = HASH_BITS) -> bytes:
    """Hash cells of the words of a chunk and of their beginnings, as packed 32-bit numbers."""
    out = []
    for w in WORDS(chunk.lower()):
        out.append(zlib.crc32(b"w" + w.encode()))
        out += [zlib.crc32(b"%d" % n + w[:n].encode()) for n in BEGINNINGS if len(w) >= n]
    mask = (1 << bits) - 1
    return array("i", [x >> 3 & mask for x in out]).tobytes()


def vector(text: str, of: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells and how many distinct chunks of the text fall in each (as log counts)."""
    found = np.frombuffer(b"".join(map(of.__getitem__, set(text.split()))), dtype=np.int32)
    ids, n = np.unique(found, return_counts=True)
    return ids.astype(np.int64), np.log1p(n)


class Chain:
    """Linear models by category; ``links[j]`` weighs the probabilities of the categories before j."""

    def __init__(self, weights: np.ndarray, links: np.ndarray, bias: np.ndarray):
        self.weights, self.links, self.bias = weights, links, bias

    def __call__(self, ids: np.ndarray, x: np.ndarray) -> list[float]:
        base, out = x @ self.weights[ids] + self.bias, []
        for j in range(len(self.bias)):
            out.append(float(sigmoid(base[j] + sum(self.links[j, i] * (p - 0.5) for i, p in enumerate(out)))))
        return out


def derive(rows: list, toxic: np.ndarray, size: int) -> np.ndarray:
    """Labels by category, from the toxic label and the terms that mark it."""
    n, bad = np.zeros(size), np.zeros(size)
    for (ids, _), y in zip(rows, toxic, strict=True):
        n[ids] += 1
        bad[ids] += y
    marker = (bad >= MARKER_ROWS) & (bad >= MARKER_SHARE * n)
    hits = np.array([marker[ids].sum() for ids, _ in rows]) if rows else np.zeros(0)
    return np.stack([hits > 0, toxic > 0, (toxic > 0) & (hits >= SEVERE_TERMS)], axis=1).astype(float)


class Extended:
    """Some rows with the probabilities of the categories so far as further coordinates, put together
    when they are asked for."""

    def __init__(self, rows: list, before: np.ndarray, size: int, at: np.ndarray):
        self.rows, self.before, self.at = rows, before, at
        self.cells = size + np.arange(before.shape[1])

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, x = self.rows[self.at[i]]
        return np.concatenate([ids, self.cells]), np.concatenate([x, self.before[self.at[i]] - 0.5])


def fit_chain(rows: list, y: np.ndarray, size: int, folds: int = CHAIN_FOLDS) -> Chain:
    """``rows``: (ids, values) by document; ``y``: labels by document and category."""
    k = y.shape[1]
    epochs = max(LEAST_EPOCHS, -(-UPDATES // max(1, len(rows))))
    weights, links, bias = np.zeros((size, k)), np.zeros((k, k)), np.zeros(k)
    before = np.zeros((len(rows), 0))  # out-of-fold probabilities of the categories so far
    part = np.random.default_rng(7).permutation(len(rows)) % folds
    for j in range(k):
        full = Extended(rows, before, size, np.arange(len(rows)))
        w = Ftrl(size + k, l1=1.0).fit(full, y[:, j], epochs).weights()
        weights[:, j], links[j], bias[j] = w[:size], w[size:size + k], w[-1]
        if j + 1 < k:
            oof = np.zeros(len(rows))
            for f in range(folds):
                learn = Extended(rows, before, size, np.flatnonzero(part != f))
                w = Ftrl(size + k, l1=1.0).fit(learn, y[part != f, j], epochs).weights()
                for i in np.flatnonzero(part == f):
                    ids, x = full[i]
                    oof[i] = sigmoid(w[ids] @ x + w[-1])
            before = np.column_stack([before, oof])
    return Chain(weights, links, bias)


def train_toxicity(train: DataFrame, bits: int = HASH_BITS) -> Chain:
    """Fits the chain in one task over the bounded sample, whose vectors many tasks make."""
    size, k = 1 << bits, len(CATEGORIES)

    def vectors(batches):
        of = Memo(lambda c: cells(c, bits), MEMO_CHUNKS)
        for b in batches:
            ids, texts, y = (b.column(i).to_pylist() for i in range(3))
            rows = [vector(t, of) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "y": pa.array(y, pa.int32()),
                "ids": pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                "x": pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))})

    def fit(batches):
        rows, toxic = [], []
        for b in batches:
            rows += [(i.copy(), x.copy()) for i, x in zip(_arrays(b.column("ids")), _arrays(b.column("x")), strict=True)]
            toxic += b.column("y").to_pylist()
        chain = fit_chain(rows, derive(rows, np.array(toxic, dtype=float), size), size)
        used = np.flatnonzero(np.abs(chain.weights).sum(axis=1))
        at = np.concatenate([used, size + np.arange(k + 1)])
        w = np.concatenate([chain.weights[used], chain.links, chain.bias[None]])
        yield pa.RecordBatch.from_pydict({"i": pa.array(at), "w": pa.array(list(w), pa.list_(pa.float64()))})

    got = (train.select("doc_id", "text", "y").mapInArrow(vectors, "doc_id long, y int, ids array<int>, x array<float>")
           .repartition(1).sortWithinPartitions("doc_id", "y").select("y", "ids", "x")
           .mapInArrow(fit, "i long, w array<double>").toPandas())
    w = np.zeros((size + k + 1, k))
    if len(got):
        w[got["i"].to_numpy()] = np.stack(got["w"].to_numpy())
    return Chain(w[:size], w[size:size + k], w[-1])


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, profane, toxic, severe)``: probabilities by category for whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast((chain.weights, chain.links, chain.bias))

    def make():
        model = Chain(*shared.value)
        bits = int(len(model.weights) - 1).bit_length()
        of = worker_state(("cells", bits), lambda: Memo(lambda c: cells(c, bits), MEMO_CHUNKS))

        def run(ids, texts):
            p = [model(*vector(t, of)) for t in texts]
            return {"doc_id": ids} | {c: [x[j] for x in p] for j, c in enumerate(CATEGORIES)}
        return run
    return map_texts(id_text(docs, id_col, text_col), make, "doc_id long, " + ", ".join(f"{c} double" for c in CATEGORIES))


def toxicity(docs: DataFrame, marks: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row a document: ``doc_id, profane, toxic, severe, score, predicted`` (1: toxic).

    Null and empty texts get the intercepts' probabilities; with no label at all every
    probability is 0.5 and nothing is predicted toxic.  Texts of any length are read whole.
    Repeated rows each give a row, a null doc_id stays null, an empty table gives no rows;
    further columns are not looked at.
    """
    chain = train_toxicity(training_rows(docs, marks, "toxic", train_rows))
    return score_toxicity(docs, chain).withColumn("score", F.col("toxic")).withColumn(
        "predicted", F.when(F.col("toxic") > threshold, 1).otherwise(0))


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
