"""Repeated passages by bounded interval expansion on a Burrows-Wheeler transform (operator 10).

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a document
with a smaller doc_id.  Equal strings are brought together first: the string's least hashed
k-gram (minimizer) is the same wherever the string stands.  Consecutive strings with one
minimizer form a passage; passages whose minimizer occurs in several documents are sent to
that minimizer's bucket, equal ones as one.  There the passages' suffixes are ordered by a
Burrows-Wheeler transform, and intervals of suffixes with equal beginnings are extended
backwards, level by level: level l finds all borders whose common prefix is l long, so the
common prefixes come by increasing value, and the expansion stops at ``LENGTH``.  What then
is still one interval is one repeated string, and its smallest doc_id is known.

Steps, each an exchange of blocks of documents with buckets of hashes; what one of them has
for one of the other is a single packed value:
1. blocks send the minimizers they hold, buckets answer which of them are shared;
2. blocks send the passages of shared minimizers, equal ones of a block once, with their places;
3. buckets find repeated strings and return the places where they stand, with their smallest doc_id;
4. blocks remove the covered bytes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import documents, id_text, slices, stage

LENGTH = 50
GRAM = 20
# Bytes of text and documents in a block, and bytes in one transform.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 5000
TRANSFORM_BYTES = 1 << 20
# String starts that are hashed at a time.
HASH_BYTES = 1 << 18
# Minimizers in a bucket, roughly; more of them up to the second number before buckets are more than the third,
# since blocks and buckets both grow in number with the texts, and so what a block has for a bucket gets small.
BUCKET_ROWS, MOST_ROWS, FEW_BUCKETS = 1 << 18, 1 << 20, 1 << 8
# Bits that are sent of a minimizer beside its bucket.
REST_BITS = 27
# A minimizer in more documents than this sends its strings one by one, each to a bucket of its own hash.
HOT_DOCS = 20_000

_ODD = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------------------------
# Minimizers
# ---------------------------------------------------------------------------------

@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Minimizers:
    """Runs of string starts that share their minimizer."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, step: int = HASH_BYTES):
        self.length, self.gram, self.wide, self.step = length, min(gram, length), length - min(gram, length) + 1, step

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Hash of the k-gram at each place."""
        n, k = len(data), self.gram
        up, down = _powers(n)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        h = (sums[k:] - sums[:-k]) * down[:n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h

    def runs(self, data: np.ndarray, ends: np.ndarray):
        """``(first, last, hash)`` arrays: starts first..last of strings with one minimizer.

        ``ends``: where each document ends in ``data``; no string crosses an end.
        """
        out = []
        for at in range(0, max(len(data) - self.length + 1, 0), self.step):
            part = data[at:at + self.step + self.length - 1]
            least, size = self.hashes(part), 1
            while size < self.wide:
                jump = min(size, self.wide - size)
                least = np.minimum(least[:len(least) - jump], least[jump:])
                size += jump
            start = at + np.arange(len(least))
            document = np.searchsorted(ends, start, side="right")
            inside = start + self.length <= ends[document]
            least, start, document = least[inside], start[inside], document[inside]
            if len(start):
                new = np.append(True, (least[1:] != least[:-1]) | (document[1:] != document[:-1]))
                first = np.flatnonzero(new)
                last = np.append(first[1:] - 1, len(start) - 1)
                out.append((start[first], start[last], least[first], document[first]))
        if not out:
            return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Block:
    """The texts of some documents as one array of bytes."""

    def __init__(self, packed: bytes):
        table = pa.ipc.open_stream(packed).read_all()
        self.ids = table.column("doc_id")
        self.texts = table.column("text").to_pylist()
        self.known = self.ids.is_valid().to_numpy()
        self.docs = self.ids.fill_null(0).to_numpy()
        self.ends = np.cumsum([len(t) for t in self.texts])
        self.data = np.frombuffer(b"".join(self.texts), dtype=np.uint8)

    def runs(self, length: int):
        """Runs in documents that have an id."""
        first, last, h, doc = Minimizers(length).runs(self.data, self.ends)
        if not self.known.all():
            ok = self.known[doc]
            first, last, h, doc = first[ok], last[ok], h[ok], doc[ok]
        return first, last, h, doc


def pack_blocks(texts: DataFrame) -> DataFrame:
    """``(block, size, docs)``: some consecutive documents as one compressed Arrow stream, and their
    bytes.  What later steps exchange is a few large values instead of many texts."""
    def run(batches):
        held, size, made = [], 0, 0

        def block():
            table = pa.table({"doc_id": pa.array([r[0] for r in held], pa.int64()),
                              "text": pa.array([r[1] for r in held], pa.large_binary())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
                writer.write_table(table)
            number = TaskContext.get().partitionId() << 32 | made
            return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "size": pa.array([size], pa.int64()),
                                               "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
        for b in batches:
            for part in slices(b):
                for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held.append(row)
                    size += len(row[1])
                    if size >= BLOCK_BYTES or len(held) >= BLOCK_DOCS:
                        yield block()
                        held, size, made = [], 0, made + 1
        if held:
            yield block()
    return texts.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "block long, size long, docs binary")


def _cell(h: np.ndarray, bits: int) -> np.ndarray:
    """What is sent of a hash: the bucket and some bits more.  Equal cells of different hashes cost work, not results.

    Minimizers are least hashes, so most of them begin with zeros; multiplied, they fill all buckets alike.
    """
    return (h * np.uint64(_ODD)) >> np.uint64(64 - REST_BITS - bits)


def _bucket_bits(total: int, length: int) -> int:
    """Logarithm of the number of buckets for so many bytes of text."""
    minimizers = total // ((length - min(GRAM, length) + 2) // 2)
    few = FEW_BUCKETS.bit_length() - 1
    return min(30, max(1, min((minimizers // BUCKET_ROWS).bit_length(), max(few, (minimizers // MOST_ROWS).bit_length()))))


def _parts(cells: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Of sorted cells: the bits beside the bucket, and ``(bucket, from, to)`` of each bucket."""
    bucket = (cells >> np.uint64(REST_BITS)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(cells)])
    ends = np.append(cut[1:], len(cells))[:len(cut)]
    rest = (cells & np.uint64((1 << REST_BITS) - 1)).astype("<u4")
    return rest, list(zip(bucket[cut].tolist(), cut.tolist(), ends.tolist(), strict=True))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, each with the first bytes of all its numbers together, then the second."""
    sizes = np.array([len(a) for a in arrays], "<i8").tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(planes))


def _unpack(packed: bytes, kinds: str) -> list[np.ndarray]:
    """What ``_pack`` was given; ``kinds``: the arrays' types."""
    types = [np.dtype(k) for k in kinds.split()]
    raw, at, out = zstandard.ZstdDecompressor().decompress(packed), 8 * len(types), []
    for n, t in zip(np.frombuffer(raw, "<i8", len(types)).tolist(), types, strict=True):
        planes = np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
        at += n * t.itemsize
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, which pack better."""
    return np.diff(x, prepend=x.dtype.type(0))


def _unsteps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)


def _flat(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``begin[0], begin[0] + 1, ...``, n[0] of them, then those from ``begin[1]`` on."""
    n = n.astype(np.int64)
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _groups(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, begin, size)``: rows by code, where in ``order`` each of ``n`` codes (all in use) begins, and its rows."""
    size = np.bincount(codes, minlength=n)
    return np.argsort(codes, kind="stable"), np.cumsum(size) - size, size


# ---------------------------------------------------------------------------------
# Steps
# ---------------------------------------------------------------------------------

SENT, REPLY = "<u4 <u4 u1", "<u4 <u4"
PASSAGES, SPANS = "<u4 <u4 <i8 <i8 <u4 <u4 u1", "<u4 <u4 <i8"


def _rows(names: str, kind: pa.DataType, rows: list[tuple]) -> pa.Table:
    """``(block, bucket, value)`` rows as a table."""
    kinds = (pa.int64(), pa.int64(), kind)
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(names.split(), kinds, strict=True))})


def _send(bits: int, length: int):
    """Step 1: a block's minimizers by bucket, apart: in one of its documents, in several (with log counts)."""
    def one_block(number: int, packed: bytes) -> pa.RecordBatch:
        _, _, h, doc = Block(packed).runs(length)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        once = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[:len(h)]
        cells, n = np.unique(_cell(h[once], bits), return_counts=True)
        rest, parts = _parts(cells)
        many = n > 1
        logs = np.ceil(np.log2(n)).astype(np.uint8)
        out = [(number, bucket, _pack(_steps(rest[a:b][~many[a:b]]), _steps(rest[a:b][many[a:b]]), logs[a:b][many[a:b]]))
               for bucket, a, b in parts]
        return _rows("block bucket cells", pa.binary(), out).combine_chunks()

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from one_block(b.column(0)[i].as_py(), b.column(1)[i].as_py()).to_batches()
    return run


def _answer(hot_docs: int):
    """Step 1, bucket: which minimizers occur in several documents, and which in very many."""
    def run(table: pa.Table) -> pa.Table:
        sent = [_unpack(x, SENT) for x in table.column("cells").to_pylist()]
        x = np.concatenate([_unsteps(part) for s in sent for part in s[:2]])
        weight = np.concatenate([w for one, _, logs in sent for w in (np.ones(len(one)), 2.0 ** logs)])
        cells, where = np.unique(x, return_inverse=True)
        total = np.bincount(where, weight, len(cells))[where]
        ends = np.cumsum([len(one) + len(many) for one, many, _ in sent])
        out = []
        for block, bucket, a, b in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(),
                                       [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            mine, of = x[a:b], total[a:b]
            if (of > 1).any():
                out.append((block, bucket, _pack(*(_steps(np.sort(mine[of > least])) for least in (1, hot_docs)))))
        return _rows("block bucket cells", pa.binary(), out)
    return run


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), dtype=bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _replies(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's shared cells and its hot ones, sorted."""
    kinds: tuple[list, list] = ([], [])
    for bucket, packed in zip(table.column("bucket").to_pylist(), table.column("cells").to_pylist(), strict=True):
        for found, part in zip(kinds, _unpack(packed, REPLY), strict=True):
            found.append(_unsteps(part).astype(np.uint64) | np.uint64(bucket << REST_BITS))
    return tuple(np.sort(np.concatenate(k)) for k in kinds)


def _contents(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings one after the other, and where each ends (with 0 first)."""
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    return np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def _passages(bits: int, length: int):
    """Step 2: the passages of shared minimizers by bucket: sorted bits of the minimizer, sizes, least and most
    doc_id, how often in the block, places there, and the bytes; equal ones of a block are one."""
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if docs.num_rows and replies.num_rows:
            block = Block(docs.column("docs")[0].as_py())
            number = docs.column("block")[0].as_py()
            first, last, h, doc = block.runs(length)
            cells = _cell(h, bits)
            shared, hot = _replies(replies)
            mine = _among(cells, shared)
            first, last, cells, doc = first[mine], last[mine], cells[mine], doc[mine]
            hot = _among(cells, hot)
            if hot.any():  # each string by itself
                n = np.where(hot, last - first + 1, 1)
                inner = _flat(np.zeros(len(n), np.int64), n)
                first, last = np.repeat(first, n) + inner, np.repeat(np.where(hot, first, last), n) + inner
                cells, doc, hot = (np.repeat(x, n) for x in (cells, doc, hot))
            raw = block.data.tobytes()
            strings = pa.array([raw[a:b] for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)], pa.large_binary())
            coded = strings.dictionary_encode()
            del strings
            codes = coded.indices.to_numpy()
            order, begin, n = _groups(codes, len(coded.dictionary))
            ids = block.docs[doc][order]
            cells = cells[order][begin]
            for i in np.flatnonzero(hot[order][begin]).tolist():
                key = xxhash.xxh64_intdigest(coded.dictionary[i].as_py())
                cells[i] = key >> (64 - REST_BITS - bits)
            by_cell = np.argsort(cells, kind="stable")
            least, most = (f.reduceat(ids, begin)[by_cell] for f in (np.minimum, np.maximum))
            text, ends = _contents(coded.dictionary.take(pa.array(by_cell)))
            size, n, places = np.diff(ends).astype("<u4"), n[by_cell].astype("<u4"), first[order][_flat(begin[by_cell], n[by_cell])].astype("<u4")
            at = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            rest, parts = _parts(cells[by_cell])
            for bucket, a, b in parts:
                out.append((number, bucket, _pack(_steps(rest[a:b]), size[a:b], least[a:b], most[a:b] - least[a:b], n[a:b],
                                                  places[at[a]:at[b]], text[ends[a]:ends[b]])))
        return _rows("block bucket passages", pa.binary(), out)
    return run


def bounded_order(data: np.ndarray, length: int) -> np.ndarray:
    """Places of ``data``, taken as a ring, ordered by at least their next ``length`` bytes."""
    n = len(data)
    ring = np.resize(data, n + 8)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | ring[i:i + n].astype(np.uint64)
    order = np.argsort(key)
    new = np.append(True, key[order[1:]] != key[order[:-1]])
    size = 8
    while size < length:
        # only places that still share their rank with another are sorted on
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(open_):
            break
        group = np.cumsum(new)
        rank = np.empty(n, np.uint64)
        rank[order] = group.astype(np.uint64)
        at = order[open_]
        key = group[open_].astype(np.uint64) << np.uint64(32) | rank[(at + size) % n]
        again = np.argsort(key)
        order[open_] = at[again]
        key = key[again]
        new[open_[1:]] |= key[1:] != key[:-1]
        size *= 2
    return order


def expand_intervals(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, interval)``: places in suffix order, and the number of the interval of equal
    first ``length`` bytes that each is in.

    A border found at level l has a common prefix of l.  The border between two neighbours
    that begin with the same byte is found one level after the border between the suffixes
    that follow that byte: the transform's inverse walk leads there, so each level only
    looks up the level before, and only neighbours that are still together.
    """
    n = len(data)
    order = bounded_order(data, length)
    bwt = data[order - 1]  # the byte before each suffix; the text is taken as a ring
    back = np.argsort(bwt, kind="stable")  # from a suffix to the one that follows its first byte
    column = bwt[back]
    begins = np.append(True, column[1:] != column[:-1])  # level 0: the first bytes differ
    together = np.flatnonzero(~begins)
    for _ in range(1, length):
        if not len(together):
            break
        interval = np.cumsum(begins, dtype=np.int32)
        apart = interval[back[together]] != interval[back[together - 1]]
        begins[together[apart]] = True
        together = together[~apart]
    return order, np.cumsum(begins, dtype=np.int64) - 1


def repeated_strings(data: np.ndarray, sizes: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``(content, from, to, smallest doc_id)`` of runs of string starts, for contents of these sizes in ``data``."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    order, interval = expand_intervals(data, length)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.flatnonzero((np.arange(len(data)) + length <= np.repeat(ends, sizes))[order])
    place, interval = order[whole], interval[whole]  # strings that go on into the next content are of no document
    cut = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
    smallest = np.empty(len(data), np.int64)
    smallest[place] = np.repeat(np.minimum.reduceat(least[owner[place]], cut), np.diff(np.append(cut, len(place))))
    at = _flat(begins, sizes - length + 1)
    own, owner = smallest[at], owner[at]
    cut = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])))
    owner, stop = owner[cut], np.append(cut[1:], len(at)) - 1
    return owner, at[cut] - begins[owner], at[stop] - begins[owner], own[cut]


def _runs(keys: np.ndarray, strings: pa.Array, least: np.ndarray, most: np.ndarray, length: int) -> list[np.ndarray]:
    """``(content, from, to, smallest doc_id)`` of a bucket's different passages, some minimizers at a time.

    Equal strings have equal minimizers, so a minimizer with one single passage has nothing to
    be compared with: its strings start where the passage does.  All others are transformed.
    """
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])
    alone = new & np.append(new[1:], True)
    one = order[alone]
    one = one[least[one] < most[one]]
    sizes = np.diff(_contents(strings)[1])
    found = [(one, np.zeros(len(one), np.int64), sizes[one] - length, least[one])]
    order, keys = order[~alone], keys[~alone]
    ends = np.cumsum(sizes[order])
    a = 0
    while a < len(keys):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TRANSFORM_BYTES)) + 1
        b = int(np.searchsorted(keys, keys[min(b, len(keys)) - 1], side="right"))  # whole minimizers
        mine = order[a:b]
        data, _ = _contents(strings.take(pa.array(mine)))
        content, begin, end, smallest = repeated_strings(data, sizes[mine], least[mine], length)
        use = smallest < most[mine][content]
        found.append((mine[content[use]], begin[use], end[use], smallest[use]))
        a = b
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _repeats(length: int):
    """Step 3: for each block the places of its repeated strings: starts, bytes, and the strings' smallest doc_id."""
    def run(table: pa.Table) -> pa.Table:
        sent = [_unpack(x, PASSAGES) for x in table.column("passages").to_pylist()]
        rest = np.concatenate([_unsteps(s[0]) for s in sent])
        size, least, more, n, places, text = (np.concatenate([s[i] for s in sent]) for i in range(1, 7))
        owner = np.repeat(np.arange(len(sent)), [len(s[0]) for s in sent])
        del sent
        most = least + more
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(text)]).dictionary_encode()
        codes = coded.indices.to_numpy()
        order, begin, _ = _groups(codes, len(coded.dictionary))
        content, first, last, smallest = _runs(rest[order][begin], coded.dictionary, np.minimum.reduceat(least[order], begin),
                                               np.maximum.reduceat(most[order], begin), length)
        # every passage has its content's runs, and each of them stands wherever the passage does
        by_content, at, runs = _groups(content, len(coded.dictionary))
        passage = np.repeat(np.arange(len(codes)), runs[codes])
        run_ = by_content[_flat(at[codes], runs[codes])]
        use = smallest[run_] < most[passage]  # else no document of this block has a larger id
        passage, run_ = passage[use], run_[use]
        begins = np.cumsum(n, dtype=np.int64) - n
        start = places[_flat(begins[passage], n[passage])].astype(np.int64)
        passage, run_ = (np.repeat(x, n[passage]) for x in (passage, run_))
        start += first[run_]
        bytes_, smallest, owner = last[run_] - first[run_] + length, smallest[run_], owner[passage]
        order = np.lexsort((start, owner))
        start, bytes_, smallest = start[order].astype("<u4"), bytes_[order].astype("<u4"), smallest[order]
        ends = np.cumsum(np.bincount(owner, minlength=table.num_rows)).tolist()
        out = [(block, bucket, _pack(_steps(start[a:b]), bytes_[a:b], smallest[a:b]))
               for block, bucket, a, b in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(),
                                              [0, *ends[:-1]], ends, strict=True) if a < b]
        return _rows("block bucket spans", pa.binary(), out)
    return run


def _remove(keep_bytes: bool):
    """Step 4: what is left of each text of a block: spans whose string starts in a smaller doc_id go."""
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        if docs.num_rows:
            block = Block(docs.column("docs")[0].as_py())
            n = len(block.data)
            change = np.zeros(n + 1, np.int64)
            for packed in spans.column("spans").to_pylist():
                start, size, least = _unpack(packed, SPANS)
                start = _unsteps(start).astype(np.int64)
                doc = np.searchsorted(block.ends, start, side="right")
                use = np.flatnonzero(block.known[doc] & (least < block.docs[doc]))
                np.add.at(change, start[use], 1)
                np.add.at(change, start[use] + size[use], -1)
            gone = np.cumsum(change[:-1]) > 0
            begins = np.concatenate([[0], block.ends[:-1]])
            new = gone.copy()
            new[1:] &= ~gone[:-1]
            inside = begins[begins < n]
            new[inside] = gone[inside]
            so_far, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, new))
            left = memoryview(block.data[~gone].tobytes())
            for doc, size, a, b in zip(block.ids.to_pylist(), map(len, block.texts), begins.tolist(), block.ends.tolist(), strict=True):
                kept = left[a - int(so_far[a]):b - int(so_far[b])]
                row = (doc, size, int(so_far[b] - so_far[a]), int(runs[b] - runs[a]), hashlib.sha256(kept).hexdigest(),
                       bytes(kept) if keep_bytes else None)
                for c, x in zip(out, row, strict=True):
                    out[c].append(x)
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(),
                 "kept_sha256": pa.string(), "kept": pa.binary()}
        return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()})
    return run


# ---------------------------------------------------------------------------------
# Operator
# ---------------------------------------------------------------------------------

def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   keep_bytes: bool = False, hot_docs: int = HOT_DOCS) -> DataFrame:
    """One row a document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes left).

    Texts are UTF-8 bytes, null counts as empty; texts below ``length`` bytes stay whole, and a
    text longer than a block is a block of its own.
    Rows of one doc_id are one document and do not remove each other's bytes.  Rows with a
    null doc_id have no place in the order: they stay whole and remove nothing.  Equal
    passages are found by their bytes.  Further columns are not looked at; an
    empty table gives no rows.
    """
    blocks = stage(pack_blocks(id_text(docs, id_col, text_col)))
    total = blocks.agg(F.sum("size")).first()[0] or 0
    blocks = blocks.select("block", "docs")
    bits = _bucket_bits(int(total), length)

    cells = "block long, bucket long, cells binary"
    replies = blocks.mapInArrow(_send(bits, length), cells).groupBy("bucket").applyInArrow(_answer(hot_docs), cells)
    passages = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _passages(bits, length), "block long, bucket long, passages binary")
    spans = passages.groupBy("bucket").applyInArrow(_repeats(length), "block long, bucket long, spans binary")
    out = blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(
        _remove(keep_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_bytes else out.drop("kept")


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
