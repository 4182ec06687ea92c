"""Document log-likelihood under a gated recurrent language model (operator 3).

Tokens are counted over all training documents.  Each word belongs to a class (its ending);
a class has one slot for each of its frequent words and one for all others.  The model
predicts class and slot from its state, and within the last slot words follow their counts:
``p(w) = p(class | state) p(slot | class, state) p(w | slot)``.  It is trained in numpy by
truncated backpropagation, each task on its own documents from common weights, which are
then averaged; scoring carries the state across windows to the end of each document.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import bounded_batches, documents, frequent_terms, id_text, slices, stage
from ticketlake.llm.quality import fold_of
from ticketlake.operators.term_blocks import _opened, _shut

FOLDS, HELD_FOLD = 7, 2
# Documents and bytes of text in a block.
BLOCK_DOCS, BLOCK_BYTES = 4000, 12 << 20
# Distinct words of the corpus in a bucket, roughly, from its bytes of text.
BUCKET_BYTES = 8 << 20
# Words of at least 1/HEAD_WORDS of all tokens get slots, endings of at least 1/ENDINGS classes.
HEAD_WORDS, ENDINGS = 4096, 128
ENDING_BYTES = 2
HIDDEN, WINDOW, BATCH = 24, 32, 64
RATE, SEED = 0.01, 11
# Each training document belongs to one round, so that together they are one pass over all.
ROUNDS = 2
# Hidden states that wait before the output layer takes them together.
OUTPUT_ROWS = 40_000


# ---------------------------------------------------------------------------------
# Blocks of tokens and corpus counts
# ---------------------------------------------------------------------------------

# The value holds sizes, tokens, words and their counts in training documents.  As one compressed value a block takes
# little of a reader's memory, which holds all blocks of a file at once.
BLOCK_SCHEMA = "block long, ids array<long>, held array<boolean>, word_bytes long, value binary"


def _packed(sizes: list[int], stream: np.ndarray, words: list[bytes], counts: np.ndarray) -> bytes:
    return _shut(np.array(sizes, np.int32), stream, counts, np.array([len(w) for w in words], np.int32), np.frombuffer(b"".join(words), np.uint8))


def _unpacked(value: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Tokens of each document, the tokens of all, the words they stand for, and the words' counts in training documents."""
    sizes, stream, counts, lengths, data = _opened(value)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return sizes.astype(np.int64), stream.astype(np.int64), words, counts


def token_blocks(texts: DataFrame) -> DataFrame:
    """``texts (doc_id, text, held)`` as blocks: token numbers, and the words they stand for."""
    bounded_batches(texts.sparkSession)

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        made, held_back, size = count(), [], 0

        def block():
            number: dict[bytes, int] = defaultdict(count().__next__)
            stream, sizes, train = [], [], Counter()
            for _, text, held in held_back:
                ids = list(map(number.__getitem__, text.lower().split()))  # bytes: A-Z only, ASCII blanks only
                stream.append(np.asarray(ids, dtype=np.int32))
                sizes.append(len(ids))
                if not held:
                    train.update(ids)
            counts = np.zeros(len(number), np.int32)
            if train:
                counts[np.fromiter(train.keys(), np.int64, len(train))] = np.fromiter(train.values(), np.int64, len(train))
            one = lambda x, t: pa.array([x], pa.list_(t))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([part | next(made)], pa.int64()), "ids": one([r[0] for r in held_back], pa.int64()),
                "held": one([r[2] for r in held_back], pa.bool_()), "word_bytes": pa.array([sum(map(len, number))], pa.int64()),
                "value": pa.array([_packed(sizes, np.concatenate(stream), list(number), counts)], pa.binary())})
        for b in batches:
            for part_rows in slices(b):
                for row in zip(*(part_rows.column(i).to_pylist() for i in range(3)), strict=True):
                    held_back.append(row)
                    size += len(row[1])
                    if len(held_back) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                        yield block()
                        held_back, size = [], 0
        if held_back:
            yield block()
    return texts.mapInArrow(run, BLOCK_SCHEMA)


def _lists(column) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a - at[0]:b - at[0]] for a, b in zip(at[:-1], at[1:], strict=True)]


def exchange_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """``(block, bucket, words, counts)``: every block's words with their corpus counts, in the
    order they were sent; and for each bucket, under block -1, its distinct words."""
    def send(batches):
        for b in batches:
            for i in range(b.num_rows):
                _, _, words, counts = _unpacked(b.column("value")[i].as_py())
                counts = pa.array(counts)
                cell = np.array([zlib.crc32(w) for w in words.to_pylist()], dtype=np.int64) % buckets
                order = np.argsort(cell, kind="stable")
                cut = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0)) if len(order) else np.zeros(0, np.int64)
                ends = np.append(cut[1:], len(order)).astype(np.int32)
                at = pa.array(np.append(cut, len(order)).astype(np.int32))
                take = pa.array(order)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([b.column("block")[i].as_py()] * len(cut), pa.int64()),
                    "bucket": pa.array(cell[order][cut], pa.int64()),
                    "words": pa.ListArray.from_arrays(at, words.take(take)) if len(ends) else pa.array([], pa.list_(pa.binary())),
                    "counts": pa.ListArray.from_arrays(at, counts.take(take).cast(pa.int64()))
                    if len(ends) else pa.array([], pa.list_(pa.int64()))})

    def add(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        words = _one(table.column("words"))
        sizes = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        total = np.bincount(codes, _one(table.column("counts")).flatten().to_numpy(), len(coded.dictionary)).astype(np.int64)
        known = np.flatnonzero(total)
        number = table.column("bucket")[0].as_py()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        replies = [total[codes[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({
            "block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()),
            "bucket": pa.array([number] * (len(sizes) + 1), pa.int64()),
            "words": pa.array([None] * len(sizes) + [coded.dictionary.take(pa.array(known)).to_pylist()], pa.list_(pa.binary())),
            "counts": pa.array([*replies, total[known]], pa.list_(pa.int64()))})
    schema = "block long, bucket long, words array<binary>, counts array<long>"
    sent = blocks.select("block", "value").mapInArrow(send, schema)
    return sent.groupBy("bucket").applyInArrow(add, schema)


def _one(column):
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def word_counts(exchanged: DataFrame) -> DataFrame:
    """``(term, n)`` of the training documents."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"term": b.column("words").flatten(), "n": b.column("counts").flatten()})
    return exchanged.where("block = -1").select("words", "counts").mapInArrow(run, "term binary, n long")


# ---------------------------------------------------------------------------------
# Classes and slots
# ---------------------------------------------------------------------------------

class Lexis:
    """Classes by ending, slots by frequent word, and counts of what shares a class's last slot."""

    def __init__(self, head: list[tuple[bytes, int]], endings: list[bytes], ends: int, rest: dict[bytes, tuple[int, int]]):
        """``ends``: training documents; ``rest``: by ending (b"": all others) tokens and distinct words without a slot."""
        self.endings = {e: k for k, e in enumerate(endings)}
        self.other, self.end = len(endings), len(endings) + 1
        self.classes = self.end + 1
        self.of: dict[bytes, tuple[int, int]] = {}  # frequent word -> class, slot
        self.weights: list[list[float]] = [[] for _ in range(self.classes)]
        for w, n in head:
            k = self.endings.get(w[-ENDING_BYTES:], self.other)
            self.of[w] = k, len(self.weights[k])
            self.weights[k].append(float(n))
        self.cells = np.ones(self.classes)  # tokens and distinct words of the last slot, and one for the unknown
        for e, (n, v) in rest.items():
            self.cells[self.endings.get(e, self.other)] += n + v
        for k in range(self.classes):
            self.weights[k].append(float(ends + 1) if k == self.end else float(self.cells[k]))
        self.slots = np.array([len(w) for w in self.weights])
        self.first = np.cumsum(self.slots) - self.slots  # slots of all classes in one row
        # By powers of two of their slots: classes, and the cells of each, filled up with one past the last.
        self.group = np.where(self.slots > 1, 1 << np.ceil(np.log2(self.slots)).astype(np.int64), 0)
        self.padded = []
        for width in np.unique(self.group[self.group > 0]):
            members, slot = np.flatnonzero(self.group == width), np.arange(width)
            self.padded.append((width, members, np.where(slot < self.slots[members, None], self.first[members, None] + slot,
                                                         int(self.slots.sum()))))
        # Where each class comes when groups lie together (a short type, which sorts faster).
        self.place = np.argsort(np.argsort(self.group, kind="stable")).astype(np.uint16)
        self.inputs = int(self.slots.sum()) + 1  # each slot, and the start
        self.start = self.inputs - 1

    def code(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Class and slot of words; the last slot for words without their own."""
        ks, ss = [], []
        of, endings, other, last = self.of, self.endings, self.other, (self.slots - 1).tolist()
        for w in words:
            hit = of.get(w)
            if hit is None:
                k = endings.get(w[-ENDING_BYTES:], other)
                hit = k, last[k]
            ks.append(hit[0])
            ss.append(hit[1])
        return np.array(ks, np.int64), np.array(ss, np.int64)


def build_lexis(counts: DataFrame, docs_trained: int) -> Lexis:
    """Frequent words and endings (both of bounded number) and one aggregate by ending."""
    head = frequent_terms(counts, HEAD_WORDS)
    by_ending = counts.groupBy(F.expr(f"substring(term, greatest(length(term) - {ENDING_BYTES - 1}, 1), {ENDING_BYTES})").alias("term"))
    endings = [bytes(e) for e, _ in frequent_terms(stage(by_ending.agg(F.sum("n").alias("n"))), ENDINGS)]
    kept = F.expr(f"substring(term, greatest(length(term) - {ENDING_BYTES - 1}, 1), {ENDING_BYTES})")
    rest: dict[bytes, list[int]] = {}
    named = F.when(kept.isin([F.lit(bytearray(e)) for e in endings]), kept).otherwise(F.lit(bytearray())) if endings else F.lit(bytearray())
    for r in counts.groupBy(named.alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        rest[bytes(r["e"])] = [r["n"], r["v"]]
    head = [(bytes(w), n) for w, n in head]
    for w, n in head:  # they have slots of their own
        e = w[-ENDING_BYTES:]
        cell = rest[e if e in endings else b""]
        cell[0] -= n
        cell[1] -= 1
    return Lexis(head, endings, docs_trained, {e: (n, v) for e, (n, v) in rest.items()})


# ---------------------------------------------------------------------------------
# The network
# ---------------------------------------------------------------------------------

def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(exponentials, their sums)`` of rows, after subtracting from ``logits`` one shift for all
    rows, or where rows lie too far apart for that, each row's largest."""
    logits -= logits.max()
    e = np.exp(logits)
    total = e @ np.ones(e.shape[1], e.dtype)
    if not total.min() > 1e-30:
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        total = e @ np.ones(e.shape[1], e.dtype)
    return e, total


class Gru:
    """Gated recurrent network with a class-factored output, in numpy (single precision)."""

    NAMES = ("embed", "recur", "to_class", "class_bias", "to_slot", "slot_bias")

    def __init__(self, lexis: Lexis, params: dict[str, np.ndarray] | None = None, seed: int = SEED, hidden: int = HIDDEN):
        self.lexis, self.hidden = lexis, hidden
        if params is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([np.asarray(w) for w in lexis.weights])
            by_class = np.array([sum(w) for w in lexis.weights])
            params = {"embed": rng.normal(0, 0.3, (lexis.inputs, 3 * hidden)),
                      "recur": rng.normal(0, 0.7 / np.sqrt(hidden), (hidden, 3 * hidden)),
                      "to_class": np.zeros((hidden, lexis.classes)), "class_bias": np.log(by_class / by_class.sum()),
                      "to_slot": np.zeros((hidden, len(flat))), "slot_bias": np.log(flat)}
        self.p = {k: v.astype(np.float32) for k, v in params.items()}
        self.mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.square = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = 0

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for k in self.NAMES:
            self.p[k] = flat[at:at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size
        return self

    def step(self, x: np.ndarray, h: np.ndarray):
        return self.advance(self.p["embed"][x], h)

    def advance(self, a: np.ndarray, h: np.ndarray):
        n = self.hidden
        u = h @ self.p["recur"]
        gates = _sigmoid(a[:, :2 * n] + u[:, :2 * n])
        z, r = gates[:, :n], gates[:, n:]
        c = np.tanh(a[:, 2 * n:] + r * u[:, 2 * n:])
        return c + z * (h - c), z, r, c, u[:, 2 * n:]

    def outputs(self, h: np.ndarray, k: np.ndarray, s: np.ndarray, grads: dict | None = None):
        """Log probabilities (natural) of classes ``k`` and slots ``s``; with ``grads`` also adds
        the gradients of the mean loss and returns the one of ``h``."""
        p, lex = self.p, self.lexis
        logits = h @ p["to_class"] + p["class_bias"]
        e, total = _softmax(logits)
        rows = np.arange(len(k))
        out = logits[rows, k] - np.log(total)
        dh = None
        if grads is not None:
            d = e
            d /= total[:, None]
            d[rows, k] -= 1
            d /= len(k)
            grads["to_class"] += h.T @ d
            grads["class_bias"] += np.ones(len(d), d.dtype) @ d
            dh = d @ p["to_class"].T
        places = lex.place[k]
        order = np.argsort(places, kind="stable")
        places = places[order]
        if lex.padded:
            padded = np.append(p["slot_bias"], np.float32(-np.inf)).astype(h.dtype)
        for width, members, cells in lex.padded:  # classes of about the same number of slots together
            start, stop = np.searchsorted(places, [lex.place[members[0]], lex.place[members[-1]] + 1])
            if start == stop:
                continue
            mine = order[start:stop]
            km, hm = k[mine], h[mine]
            bounds = np.searchsorted(km, np.append(members, lex.classes))
            parts = [(slice(a, b), slice(lex.first[c], lex.first[c] + lex.slots[c]), lex.slots[c])
                     for c, a, b in zip(members, bounds[:-1], bounds[1:], strict=True) if a < b]
            logits = padded[cells[np.searchsorted(members, km)]]
            for at, own, n in parts:
                logits[at, :n] += hm[at] @ p["to_slot"][:, own]
            e, total = _softmax(logits)
            rows = np.arange(len(mine))
            out[mine] += logits[rows, s[mine]] - np.log(total)
            if grads is not None:
                d = e
                d /= total[:, None]
                d[rows, s[mine]] -= 1
                d /= len(k)
                back = np.empty_like(hm)
                for at, own, n in parts:
                    mine_d = d[at, :n]
                    grads["to_slot"][:, own] += hm[at].T @ mine_d
                    grads["slot_bias"][own] += np.ones(len(mine_d), d.dtype) @ mine_d
                    np.matmul(mine_d, p["to_slot"][:, own].T, out=back[at])
                dh[mine] += back
        return out, dh

    def update(self, grads: dict, rate: float = RATE) -> None:
        """One Adam step with clipped gradients."""
        self.steps += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        fix = np.sqrt(1 - 0.999 ** self.steps) / (1 - 0.9 ** self.steps)
        for k, g in grads.items():
            g = g * np.float32(scale)
            self.mean[k] += np.float32(0.1) * (g - self.mean[k])
            self.square[k] += np.float32(0.001) * (g * g - self.square[k])
            self.p[k] -= np.float32(rate * fix) * self.mean[k] / (np.sqrt(self.square[k]) + np.float32(1e-7))

    def train_window(self, x: np.ndarray, k: np.ndarray, s: np.ndarray, active: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Truncated backpropagation through one window; returns the state to carry on.

        ``x, k, s``: (steps, streams); step t concerns the first ``active[t]`` streams.  Where
        the input is the start of a document, the state begins anew.
        """
        n, grads = self.hidden, {k_: np.zeros_like(v) for k_, v in self.p.items()}
        steps, m = len(active), int(active[0])
        live = np.arange(m) < np.asarray(active)[:, None]
        x, recur = x[:, :m], self.p["recur"]
        go_on = (x != self.lexis.start).astype(h.dtype)[:, :, None]
        begins = ~go_on.all(axis=(1, 2))
        inputs = self.p["embed"][x]
        before, z, r, c, u = (np.empty((steps, m, n), h.dtype) for _ in range(5))
        states = np.empty((steps, m, n), h.dtype)
        for t in range(steps):  # streams that have ended go on with steps that nothing depends on
            was = states[t - 1] if t else h[:m]
            before[t] = was * go_on[t] if begins[t] else was
            states[t], z[t], r[t], c[t], u[t] = self.advance(inputs[t], before[t])
        _, dlive = self.outputs(states[live], k[:, :m][live], s[:, :m][live], grads)
        dout = np.zeros_like(states)
        dout[live] = dlive
        to_c = (1 - z) * (1 - c * c)
        # of the state's gradient, what the three recurrent inputs get
        share = np.stack([(before - c) * z * (1 - z), to_c * u * r * (1 - r), to_c * r], axis=2)
        inner = np.empty((steps, m, 3, n), h.dtype)
        carry, back = np.zeros((m, n), h.dtype), np.ascontiguousarray(recur.T)
        for t in range(steps - 1, -1, -1):
            d = dout[t]
            d += carry
            np.multiply(d[:, None], share[t], out=inner[t])
            carry = d * z[t] + inner[t].reshape(m, 3 * n) @ back
            if begins[t]:
                carry *= go_on[t]
        flat = inner.reshape(steps * m, 3 * n)
        grads["recur"] += before.reshape(steps * m, n).T @ flat
        flat[:, 2 * n:] = (dout * to_c).reshape(steps * m, n)
        ids = x.ravel()
        order = np.argsort(ids.astype(np.uint16) if self.lexis.inputs < 1 << 16 else ids, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
        grads["embed"][ids[order][cut]] = np.add.reduceat(flat[order], cut, axis=0)
        h = np.concatenate([states[-1], h[m:]]) if m < len(h) else states[-1]
        self.update(grads)
        return h


class Documents:
    """Documents of a block in batches of similar length, longest first."""

    def __init__(self, lexis: Lexis, words: list[bytes], stream: np.ndarray, sizes: np.ndarray):
        k, s = lexis.code(words)
        self.k, self.s = np.append(k, lexis.end), np.append(s, 0)  # the end comes after all words
        self.x = lexis.first[self.k] + self.s
        self.lexis, self.stream, self.sizes = lexis, stream, sizes
        self.starts = np.cumsum(sizes) - sizes

    def batches(self, chosen: np.ndarray, size: int):
        order = chosen[np.argsort(-self.sizes[chosen], kind="stable")]
        for i in range(0, len(order), size):
            yield order[i:i + size]

    def windows(self, docs: np.ndarray, steps: int):
        """``(inputs, word numbers, active)`` of each window of the batch; the end is the last number."""
        starts, sizes = self.starts[docs], self.sizes[docs]
        for t0 in range(0, int(sizes[0]) + 1, steps):
            t = np.arange(t0, min(t0 + steps, int(sizes[0]) + 1))
            active = np.searchsorted(-sizes, -t, side="right")  # documents with a token or their end at t
            m = int(active[0])
            at = starts[:m] + t[:, None]
            word = np.where(t[:, None] < sizes[:m], self._token(at), len(self.k) - 1)
            before = np.where(t[:, None] > 0, self.x[self._token(at - 1)], self.lexis.start)
            yield before, word, active

    def _token(self, at: np.ndarray) -> np.ndarray:
        return self.stream[np.clip(at, 0, len(self.stream) - 1)] if len(self.stream) else np.zeros(at.shape, np.int64)


def train(model: Gru, docs: Documents, chosen: np.ndarray) -> int:
    """One pass over the chosen documents, one after the other in ``BATCH`` streams of equal
    length (a document cut by that goes on with a new state); returns their tokens."""
    sizes = docs.sizes[chosen]
    ends = np.cumsum(sizes + 1) - 1
    total = int(ends[-1]) + 1
    inside = np.ones(total, dtype=bool)
    inside[ends] = False
    word = np.full(total, len(docs.k) - 1)
    offset = np.repeat(docs.starts[chosen] - (np.cumsum(sizes) - sizes), sizes)
    word[inside] = docs.stream[np.arange(len(offset)) + offset]
    x = np.append(docs.lexis.start, docs.x[word[:-1]])
    x[ends[:-1] + 1] = docs.lexis.start
    long = -(-total // BATCH)
    first = np.arange(0, total, long)
    h = np.zeros((len(first), model.hidden), np.float32)
    for t0 in range(0, long, WINDOW):
        at = first + np.arange(t0, min(t0 + WINDOW, long))[:, None]
        active = (at < np.minimum(first + long, total)).sum(axis=1)
        at = np.minimum(at, total - 1)
        h = model.train_window(x[at], docs.k[word[at]], docs.s[word[at]], active, h)
    return total


def score(model: Gru, docs: Documents, count_logs: np.ndarray) -> np.ndarray:
    """Natural log probability of each document; ``count_logs``: of each word (and the end) within its slot."""
    out = np.zeros(len(docs.sizes))
    waiting, rows = [], 0

    def settle():
        h, word, doc = (np.concatenate([w[i] for w in waiting]) for i in range(3))
        logs, _ = model.outputs(h, docs.k[word], docs.s[word])
        out[:] += np.bincount(doc, logs + count_logs[word], len(out))
    for batch in docs.batches(np.arange(len(docs.sizes)), 2048):
        h = np.zeros((len(batch), model.hidden), np.float32)
        for x, word, active in docs.windows(batch, WINDOW):
            inputs = model.p["embed"][x]
            for t, m in enumerate(active):
                h = model.advance(inputs[t, :m], h[:m])[0]
                waiting.append((h, word[t, :m], batch[:m]))
                rows += m
            if rows >= OUTPUT_ROWS:
                settle()
                waiting, rows = [], 0
    if waiting:
        settle()
    return out


# ---------------------------------------------------------------------------------
# Operator
# ---------------------------------------------------------------------------------

def fit(blocks: DataFrame, lexis: Lexis, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after ``rounds`` rounds: every task trains on its own documents from the common
    weights, and the results are averaged by tokens, first in 32 groups and then here."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(lexis)
    flat = Gru(lexis).flat()
    for number in range(rounds):
        start = spark.sparkContext.broadcast(flat)

        def run(batches, start=start, number=number):
            model, tokens = Gru(shared.value).load(start.value), 0
            for b in batches:
                for i in range(b.num_rows):
                    sizes, stream, words, _ = _unpacked(b.column("value")[i].as_py())
                    chosen = np.flatnonzero(~b.column("held")[i].values.to_numpy(zero_copy_only=False))
                    chosen = chosen[np.arange(len(chosen)) % rounds == number]
                    if len(chosen):  # else nothing to learn here
                        docs = Documents(shared.value, words.to_pylist(), stream, sizes)
                        tokens += train(model, docs, chosen)
            if tokens:
                yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % 32], pa.int32()),
                                                  "tokens": pa.array([tokens], pa.int64()),
                                                  "flat": pa.array([model.flat()], pa.list_(pa.float32()))})

        def average(batches):
            total, tokens = {}, Counter()
            for b in batches:
                for p, n, w in zip(b.column("part").to_pylist(), b.column("tokens").to_pylist(), _lists(b.column("flat")), strict=True):
                    total[p] = total.get(p, 0) + w.astype(np.float64) * n
                    tokens[p] += n
            if total:
                yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()),
                                                  "tokens": pa.array([tokens[p] for p in total], pa.int64()),
                                                  "flat": pa.array([(total[p] / tokens[p]).astype(np.float32) for p in total],
                                                                   pa.list_(pa.float32()))})
        schema = "part int, tokens long, flat array<float>"
        trained = blocks.select("held", "value").mapInArrow(run, schema)
        got = trained.repartition(32, "part").mapInArrow(average, schema).toPandas()
        if len(got):
            n = got["tokens"].to_numpy(dtype=float)
            flat = (np.stack(got["flat"].to_numpy()) * n[:, None]).sum(axis=0) / n.sum()
    return flat.astype(np.float32)


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS,
                    held_fold: int = HELD_FOLD) -> DataFrame:
    """One row a document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Words are runs without ASCII blanks, A-Z in lower case, and each document ends with one
    end token; null and empty texts are an end alone.  Held-out documents (crc32 of the id
    modulo ``folds``) add nothing to counts or weights; a null id counts as the empty text.
    Without training documents every token is unknown.  Repeated rows each give a row and
    count; further columns are not looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    held = (fold_of(F.col(id_col), folds) == held_fold).alias("held")
    texts = id_text(docs, id_col, text_col, held).withColumn("text", F.col("text").cast("binary"))
    blocks = stage(token_blocks(texts))
    size = blocks.agg(F.sum("word_bytes"), F.sum(F.size(F.filter("held", lambda h: ~h)))).first()
    exchanged = stage(exchange_counts(blocks, int(size[0] or 0) // BUCKET_BYTES + 1))
    counts = word_counts(exchanged)
    trained = int(size[1] or 0)
    total = counts.agg(F.sum("n"), F.count("*")).first()
    n, v = int(total[0] or 0) + trained, int(total[1]) + (trained > 0)
    lexis = build_lexis(counts, trained)
    shared = spark.sparkContext.broadcast((lexis, fit(blocks, lexis)))
    floor = np.log10(n + v + 1.0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        if left.num_rows:
            lex, weights = shared.value
            sizes, stream, words, _ = _unpacked(left.column("value")[0].as_py())
            c = np.zeros(len(words), np.int64)
            if len(words):
                plain = words.to_pylist()
                buckets = max(1, right.column("of")[0].as_py())
                order = np.argsort(np.array([zlib.crc32(w) for w in plain], dtype=np.int64) % buckets, kind="stable")
                replies = right.sort_by("bucket").column("counts").combine_chunks()
                c[order] = replies.flatten().to_numpy()
            else:
                plain = []
            c = np.append(c, trained)
            docs_ = Documents(lex, plain, stream, sizes)
            last = docs_.s == lex.slots[docs_.k] - 1
            logs = np.where(last & (docs_.k != lex.end), np.log((c + 1.0) / lex.cells[docs_.k]), 0.0)
            if not trained:
                logs[-1] = 0.0
            doc = np.repeat(np.arange(len(sizes)), sizes)
            base = np.log10(c + 1.0)
            out["doc_id"] = left.column("ids")[0].values
            out["held_out"] = left.column("held")[0].values
            out["n_tokens"] = sizes + 1
            out["n_known"] = np.bincount(doc, c[stream] > 0, len(sizes)).astype(np.int64) + (trained > 0)
            out["base_score"] = np.bincount(doc, base[stream], len(sizes)) + base[-1] - (sizes + 1) * floor
            out["score"] = score(Gru(lex).load(weights), docs_, logs) / np.log(10.0)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({k: pa.array(x, t) for (k, x), t in zip(out.items(), kinds, strict=True)})

    buckets = int(size[0] or 0) // BUCKET_BYTES + 1
    replies = exchanged.where("block >= 0").select("block", "bucket", "counts", F.lit(buckets).alias("of"))
    rows = (blocks.select("block", "ids", "held", "value").groupBy("block")
            .cogroup(replies.groupBy("block")).applyInArrow(
                run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                       "base_score", "score")


def op3_gru_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(documents(spark, sf_dir))
