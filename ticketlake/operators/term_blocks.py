"""Terms of texts counted in blocks of rows.

A block is a bounded number of rows' words or characters as arrays.  Its terms, runs of units, are
integers while they are counted; only a block's distinct terms become strings.  They are shuffled packed:
a block sends each bucket of terms one compressed value, and gets one back where it asks.
"""

from __future__ import annotations

import math
import uuid
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake.functions.text import tokenize
from ticketlake.session import bound_batches, checkpoint_dir

WORDS, CHARS = 1 << 19, 1 << 20  # units of a block
KNOWN_UNITS = 1 << 18  # of a block that only meets a vocabulary: nothing is sent, so that it can be smaller
BUCKET_TERMS = 1 << 21  # terms that blocks send to one bucket, about
BUCKET_BYTES = 4 << 20  # of the texts' files, for a bucket of that many


class Grams(NamedTuple):
    """Terms of a row: runs of ``low`` to ``high`` units, joined by ``joint``, which no unit holds.
    ``units``: an array of words, or a string whose characters are the units."""
    units: Column
    low: int
    high: int
    joint: str


def word_grams(text: Column, ngram: tuple[int, int] = (1, 2)) -> Grams:
    """Word n-grams of tokens with at least two word characters."""
    return Grams(F.filter(tokenize(text), lambda t: F.length(t) >= 2), *ngram, " ")


def char_grams(text: Column, ngram: tuple[int, int] = (3, 5)) -> Grams:
    """Character n-grams of the lower-cased text."""
    return Grams(F.lower(text), *ngram, "")


def listed(terms: Column | Grams) -> Grams:
    """A column of lists of terms as runs of one unit."""
    return terms if isinstance(terms, Grams) else Grams(terms, 1, 1, "")


# ---------------------------------------------------------------------------------
# One block
# ---------------------------------------------------------------------------------

def _tables(batches, every: bool = False, bound: int | None = None):
    """Rows of an Arrow stream as tables of a bounded number of units, one row at least; the units are the last column.
    Last rows without any unit are left out unless ``every`` row is asked for."""
    import pyarrow as pa
    import pyarrow.compute as pc
    held, size = [], 0
    for b in batches:
        units = b.column(b.num_columns - 1)
        words = pa.types.is_list(units.type)
        most = bound or (WORDS if words else CHARS)
        length = pc.fill_null((pc.list_value_length if words else pc.binary_length)(units), 0).to_numpy(zero_copy_only=False)
        start = 0
        for at, n in enumerate(length.tolist()):
            if size + n > most and (held or at > start):
                held.append(b.slice(start, at - start))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, start = [], 0, at
            size += n
        held.append(b.slice(start))
    if size or every and any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _coded(units):
    """Codes of all units of a block in order, how many each row has, and the units' names."""
    import pyarrow as pa
    import pyarrow.compute as pc
    units = units.combine_chunks() if isinstance(units, pa.ChunkedArray) else units
    if pa.types.is_list(units.type):
        length = pc.fill_null(pc.list_value_length(units), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = units.flatten().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), length, coded.dictionary
    length = pc.fill_null(pc.utf8_length(units), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.frombuffer("".join(pc.fill_null(units, "").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[text] = True
    names = pa.array([chr(c) for c in np.flatnonzero(seen)], pa.string())
    return (np.cumsum(seen) - 1)[text], length, names


def _runs(code, length, n_units: int, low: int, high: int):
    """For each run length ``n``: ``(n, key, row)`` of every run; equal keys are equal runs.  A key holds its units as
    digits, or digits above a number from ``parts`` where these would not fit."""
    end = np.repeat(np.cumsum(length), length)
    row = np.repeat(np.arange(len(length)), length)
    place, key, base = np.arange(len(code)), code, n_units
    parts = {}
    for n in range(1, high + 1):
        if n > 1:
            ok = place[:len(key)] + n <= end[:len(key)]
            keep = np.flatnonzero(ok)
            if base * n_units * max(1, len(length)) >= 1 << 62:  # digits would not fit
                parts[n - 1], key = np.unique(key, return_inverse=True)
                base = max(1, len(parts[n - 1]))
            key = key[keep] * n_units + code[place[keep] + n - 1]
            place, end, row, base = place[keep], end[keep], row[keep], base * n_units
        if n >= low:
            yield n, key, row, parts


def _units(keys, n: int, n_units: int, parts: dict) -> list:
    """For every place of distinct keys of ``n`` units the number of the unit there."""
    digits, k = [], keys
    for i in range(n, 1, -1):
        digits.append(k % n_units)
        k = k // n_units
        if i - 1 in parts:
            k = parts[i - 1][k]
    return [k, *digits[::-1]]


def _names(keys, n: int, n_units: int, names, joint: str, parts: dict):
    """Strings of distinct keys of ``n`` units."""
    import pyarrow as pa
    import pyarrow.compute as pc
    columns = [names.take(pa.array(d)) for d in _units(keys, n, n_units, parts)]
    return columns[0] if n == 1 else pc.binary_join_element_wise(*columns, joint)


def _pairs(key, row, n_rows: int):
    """Distinct ``(key, row)`` in order: keys, rows, how often they occur, and where a new key begins."""
    pairs = key * n_rows
    pairs += row
    pairs.sort()
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    tf = np.diff(first, append=len(pairs))
    pairs = pairs[first]
    of = pairs // n_rows
    new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return of, pairs - of * n_rows, tf, new


class Counted(NamedTuple):
    """Terms of a block's rows: entries by row and term, and the distinct terms, which ascend by bytes."""
    row: np.ndarray
    number: np.ndarray  # of the term
    tf: np.ndarray
    digits: list        # of each distinct term: for every place 0 or the number of its unit and one
    names: object       # of the units
    joint: str

    def __len__(self) -> int:
        return len(self.digits[0])

    def terms(self):
        """The distinct terms as strings."""
        import pyarrow as pa
        import pyarrow.compute as pc
        columns = [self.names.take(pa.array(d - 1, mask=d == 0)) for d in self.digits]
        return columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, self.joint, null_handling="skip")

    def buckets(self, n: int) -> np.ndarray:
        """Of each distinct term, from hashes of its units: the same in every block."""
        own = np.array([0, *map(_unit_hash, self.names.to_pylist())], np.uint64)
        h = np.zeros(len(self), np.uint64)
        for d in self.digits:
            h = np.where(d > 0, h * np.uint64(_MIX) + own[d], h)
        return ((h >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


_MIX = 0x9E3779B97F4A7C15


def _unit_hash(unit: str) -> int:
    return (zlib.crc32(unit.encode("utf-8", "surrogatepass")) + 1) * _MIX & (1 << 64) - 1


def _bucket(units: list[str], n: int) -> int:
    """The bucket of one term."""
    h = 0
    for u in units:
        h = h * _MIX + _unit_hash(u) & (1 << 64) - 1
    return (h >> 20) % n


def _ordered(names, joint: str) -> bool:
    """Whether terms in order of their units are in order of their bytes, a joint being less than any unit's bytes."""
    data = names.buffers()[2]
    return not joint or data is None or np.frombuffer(data, np.uint8).min(initial=255) > joint.encode()[0]


def _counted(code, length, names, grams: Grams) -> Counted:
    """The terms of a block's rows."""
    import pyarrow as pa
    import pyarrow.compute as pc
    order = pc.array_sort_indices(names).to_numpy(zero_copy_only=False).astype(np.int64)  # by bytes
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    names = names.take(pa.array(order)).cast(pa.string())
    code, base, n_rows, joint = rank[code], len(names) + 1, max(1, len(length)), grams.joint
    if grams.high == 1 or _ordered(names, joint):
        span = base ** grams.high
        if span * n_rows < 1 << 62:
            end, row = np.repeat(np.cumsum(length), length), np.repeat(np.arange(len(length)), length)
            key, made = row * span, []
            for n in range(1, grams.high + 1):
                m = max(0, len(code) - n + 1)
                ok = np.flatnonzero(np.arange(n, n + m) <= end[:m])
                key = key[:m] + code[n - 1:n - 1 + m] * base ** (grams.high - n)
                if n >= grams.low:
                    made.append(key[ok])
            del end, row, key
            key = np.concatenate(made)
            del made
            key.sort()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            tf, key = np.diff(first, append=len(key)), key[first]
            row = key // span
            key -= row * span
            distinct = np.sort(key)
            distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])] if len(distinct) else distinct
            digits = [distinct // base ** (grams.high - n) % base for n in range(1, grams.high + 1)]
            return Counted(row, np.searchsorted(distinct, key), tf, digits, names, joint)
    # keys that would not fit, or terms in another order than their units
    rows, numbers, counts, places, strings, at = [], [], [], [], [pa.array([], pa.string())], 0
    for n, key, row, parts in _runs(code - 1, length, base, grams.low, grams.high):
        of, own, tf, new = _pairs(key, row, n_rows)
        number = np.zeros(len(of), np.int64)
        number[new[1:]] = 1
        rows.append(own)
        numbers.append(np.cumsum(number) + at)
        counts.append(tf)
        units = _units(of[new], n, base, parts)
        places.append(np.stack([*[u + 1 for u in units], *[np.zeros(len(new), np.int64)] * (grams.high - n)]))
        strings.append(_names(of[new], n, base, names, joint, dict(parts)).cast(pa.string()))
        at += len(new)
    order = pc.array_sort_indices(pa.concat_arrays(strings)).to_numpy(zero_copy_only=False).astype(np.int64)  # by bytes
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    row, number, tf = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, numbers, counts))
    number = rank[number]
    by = np.argsort(row * max(1, len(rank)) + number)
    return Counted(row[by], number[by], tf[by], list(np.concatenate(places, axis=1)[:, order]), names, joint)


def lists(values, sizes):
    """Values in order as an Arrow array of lists of these sizes."""
    import pyarrow as pa
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _vectors(ids, n_rows: int, terms, idf, row, number, tf, sublinear: bool, places: int | None, namespace: str | None):
    """``id, terms, weights`` of the rows that have a term: TF-IDF at unit length."""
    import pyarrow as pa
    import pyarrow.compute as pc
    w = ((1.0 + np.log(tf)) if sublinear else tf.astype(np.float64)) * idf[number]
    norm = np.sqrt(np.bincount(row, weights=w * w, minlength=n_rows))
    w = w / norm[row]
    if places is not None:
        w = np.round(w, places)
    sizes = np.bincount(row, minlength=n_rows)
    some = np.flatnonzero(sizes)
    if namespace:
        terms = pc.binary_join_element_wise(pa.array([namespace] * len(terms), pa.string()), terms, ":")
    return pa.table({"id": ids.take(pa.array(some)), "terms": lists(terms.take(pa.array(number)), sizes[some]),
                     "weights": lists(pa.array(w), sizes[some])})


# ---------------------------------------------------------------------------------
# Packed values
# ---------------------------------------------------------------------------------

def _shut(*arrays) -> bytes:
    """Whole numbers and byte strings as one compressed value; numbers byte place by byte place, as most are small."""
    parts = [a.tobytes() if a.dtype == np.uint8 else np.ascontiguousarray(a.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    import pyarrow as pa
    raw = np.array([len(p) if a.dtype == np.uint8 else -len(p) - 1 for p, a in zip(parts, arrays, strict=True)], np.int64).tobytes() + b"".join(parts)
    return np.array([len(raw), len(parts)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _opened(value: bytes) -> list[np.ndarray]:
    import pyarrow as pa
    size, n = np.frombuffer(value, np.int64, 2)
    raw = pa.decompress(value[16:], decompressed_size=int(size), codec="zstd", asbytes=True)
    out, at = [], 8 * int(n)
    for length in np.frombuffer(raw, np.int64, int(n)).tolist():
        number, length = length < 0, length if length >= 0 else -length - 1
        a = np.frombuffer(raw, np.uint8, length, at)
        out.append(np.ascontiguousarray(a.reshape(4, -1).T).view(np.int32).ravel() if number else a)
        at += length
    return out


def _text_parts(strings) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of an array of strings."""
    import pyarrow as pa
    strings = strings.cast(pa.string())
    if not len(strings):
        return np.zeros(0, np.int32), np.zeros(0, np.uint8)
    ends = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1, 4 * strings.offset)
    data = strings.buffers()[2]
    return np.diff(ends), np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)


def _strings(lengths, data):
    """The strings again."""
    import pyarrow as pa
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


def _requests(block: int, counted: Counted, n: int, counts: list):
    """``(bucket, block, value)`` of one block: its distinct terms, dealt into ``n`` buckets, with their ``counts``:
    arrays of one number a term, or pairs of how many numbers each term has and these numbers."""
    import pyarrow as pa
    if not len(counted):
        return
    cell, terms = counted.buckets(n), counted.terms()
    order = np.argsort(cell, kind="stable")
    terms = terms.take(pa.array(order))
    cut = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0, [True]]))
    dealt = []
    for c in counts:
        if isinstance(c, tuple):
            size, values = c
            first = np.cumsum(size) - size
            take = np.repeat(first[order] - (np.cumsum(size[order]) - size[order]), size[order]) + np.arange(len(values))
            dealt.append((values[take], np.concatenate([[0], np.cumsum(size[order])])[cut]))
        else:
            dealt.append((c[order], cut))
    values = [_shut(*[v[at[i]:at[i + 1]] for v, at in dealt], *_text_parts(terms.slice(a, z - a)))
              for i, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
    yield pa.RecordBatch.from_arrays([pa.array(cell[order][cut[:-1]], pa.int32()), pa.array(np.full(len(values), block), pa.int64()),
                                      pa.array(values, pa.binary())], names=["bucket", "block", "value"])


_REQUEST = "bucket int, block long, value binary"


def _met(table):
    """Of a bucket's requests: each one's opened counts, how many terms each has, and all their terms as codes of distinct ones."""
    opened = [_opened(v) for v in table.column("value").to_pylist()]
    sizes = np.array([len(o[-2]) for o in opened], np.int64)
    coded = _strings(np.concatenate([o[-2] for o in opened]), np.concatenate([o[-1] for o in opened])).dictionary_encode()
    return [o[:-2] for o in opened], sizes, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _buckets(df: DataFrame) -> int:
    """Buckets for the terms of a table's texts, from what the planner knows of its size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 256 if size >= 1 << 50 else min(4096, max(8, size // BUCKET_BYTES))  # an unknown size is a very large one


# ---------------------------------------------------------------------------------
# Tables
# ---------------------------------------------------------------------------------

def _source(df: DataFrame, id_col: str, units: Column, *more: Column) -> DataFrame:
    bound_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), *more, units.alias("_units"))


def _id_field(df: DataFrame, id_col: str) -> T.StructField:
    return T.StructField("id", df.select(F.col(id_col).alias("id")).schema["id"].dataType)


def term_counts(df: DataFrame, id_col: str, terms: Column | Grams) -> DataFrame:
    """``(id, term, tf)``: how often each row holds each of its terms."""
    grams = listed(terms)
    schema = T.StructType([_id_field(df, id_col), T.StructField("term", T.StringType()), T.StructField("tf", T.DoubleType())])
    plain = grams._replace(units=None)

    def count(batches):
        import pyarrow as pa
        for t in _tables(batches):
            c = _counted(*_coded(t.column(t.num_columns - 1)), plain)
            yield from pa.table({"id": t.column("id").combine_chunks().take(pa.array(c.row)), "term": c.terms().take(pa.array(c.number)),
                                 "tf": c.tf.astype(np.float64)}).to_batches(1 << 18)
    return _source(df, id_col, grams.units).mapInArrow(count, schema)


def document_counts(df: DataFrame, terms: Column | Grams) -> DataFrame:
    """``(term, df, cf)``: rows that hold a term, and how often they do.  Blocks add up first; their distinct terms
    meet by bucket, packed."""
    grams = listed(terms)
    plain = grams._replace(units=None)
    bound_batches(df.sparkSession)
    units = df.select(grams.units.alias("_units"))
    n = _buckets(df)

    def count(batches):
        for t in _tables(batches):
            c = _counted(*_coded(t.column(0)), plain)
            size = len(c)
            yield from _requests(0, c, n, [np.bincount(c.number, minlength=size), np.bincount(c.number, weights=c.tf, minlength=size)])

    def add(table):
        import pyarrow as pa
        counts, _, code, names = _met(table)
        df, cf = (np.bincount(code, weights=np.concatenate([c[i] for c in counts]), minlength=len(names)).astype(np.int64) for i in (0, 1))
        return pa.table({"term": names, "df": df, "cf": cf})
    return units.mapInArrow(count, _REQUEST).groupBy("bucket").applyInArrow(add, "term string, df long, cf long")


class Known:
    """A bounded vocabulary: its terms in ascending order and their idf; terms of equal length as rows of their units."""

    def __init__(self, rows: list, grams: Grams, words: bool):
        rows = sorted(rows, key=lambda r: r[0].encode("utf-8", "surrogatepass"))
        self.terms, self.idf, self.grams = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float), grams._replace(units=None)
        cut = [t.split(grams.joint) if words and grams.joint else [t] if words else list(t) for t in self.terms]
        self.units = sorted({u for c in cut for u in c})
        place = {u: i for i, u in enumerate(self.units)}
        self.of_length = {}
        for n in range(grams.low, grams.high + 1):
            own = [i for i, c in enumerate(cut) if len(c) == n]
            self.of_length[n] = np.array(own, np.int64), np.array([[place[u] for u in cut[i]] for i in own], np.int64).reshape(-1, n)

    def found(self, table):
        """``(row, term number, tf)`` of a block's rows, by row and term."""
        import pyarrow as pa
        import pyarrow.compute as pc
        units = table.column(table.num_columns - 1)
        code, length, names = _coded(units)
        n_units, n_terms = max(1, len(names)), max(1, len(self.terms))
        here_as = pc.fill_null(pc.index_in(pa.array(self.units, pa.string()), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        hits = [np.zeros(0, np.int64)]
        for n, key, row, parts in _runs(code, length, n_units, self.grams.low, self.grams.high):
            own, units = self.of_length[n]
            units = here_as[units]
            ok = (units >= 0).all(axis=1)
            own, units = own[ok], units[ok]
            wanted = units[:, 0]
            for i in range(1, n):
                if i in parts:
                    at = np.searchsorted(parts[i], wanted)
                    ok = at < len(parts[i])
                    ok[ok] = parts[i][at[ok]] == wanted[ok]
                    own, units, wanted = own[ok], units[ok], at[ok]
                wanted = wanted * n_units + units[:, i]
            if not len(own) or not len(key):
                continue
            order = np.argsort(wanted)
            own, wanted = own[order], wanted[order]
            at = np.searchsorted(wanted, key)
            at[at == len(wanted)] = 0
            here = np.flatnonzero(wanted[at] == key)
            hits.append(row[here] * n_terms + own[at[here]])
        pairs, tf = np.unique(np.concatenate(hits), return_counts=True)
        return pairs // n_terms, pairs % n_terms, tf


def known_vectors(df: DataFrame, id_col: str, terms: list[Column | Grams], vocabularies: list[DataFrame], sublinear: bool,
                  places: int | None = None, namespaces: list[str | None] | None = None) -> DataFrame:
    """``(id, terms, weights)`` over vocabularies ``(term, idf)`` of a bounded size, several blocks side by side.

    The vocabularies are part of the fitted model and go to every task; a row's vector is made where the row is read.
    """
    grams, spaces = [listed(t) for t in terms], namespaces or [None] * len(terms)
    order = sorted(range(len(grams)), key=lambda i: spaces[i] or "")
    words = [isinstance(df.select(g.units.alias("u")).schema["u"].dataType, T.ArrayType) for g in grams]
    models = [(spaces[i], Known([tuple(r) for r in vocabularies[i].select("term", "idf").collect()], grams[i], words[i])) for i in order]
    model = df.sparkSession.sparkContext.broadcast(models)
    field = _id_field(df, id_col)
    schema = T.StructType([field, T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def make(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        for t in _tables(batches, bound=KNOWN_UNITS):
            ids, n = t.column("id").combine_chunks(), t.num_rows
            parts = []
            for i, (space, known) in enumerate(model.value):
                row, number, tf = known.found(t.select(["id", f"_u{i}"]))
                v = _vectors(pa.array(np.arange(n)), n, pa.array(known.terms, pa.string()), known.idf, row, number, tf, sublinear, places, space)
                parts.append((v.column("id").to_numpy(), v.column("terms").combine_chunks(), v.column("weights").combine_chunks()))
            rows, names, weights = parts[0]
            if len(parts) > 1:  # rows in order of their number, the blocks of a row in order of their names
                at = np.concatenate([p[0] for p in parts])
                by = np.argsort(at, kind="stable")
                names, weights = (pa.concat_arrays([p[k] for p in parts]).take(pa.array(by)) for k in (1, 2))
                rows, first = np.unique(at[by], return_index=True)
                size = pc.list_value_length(names).to_numpy(zero_copy_only=False)
                sizes = np.add.reduceat(size, first) if len(first) else size
                names, weights = lists(names.flatten(), sizes), lists(weights.flatten(), sizes)
            yield from pa.table({"id": ids.take(pa.array(rows)), "terms": names, "weights": weights}).to_batches(1 << 12)
    bound_batches(df.sparkSession)
    units = [grams[i].units.alias(f"_u{k}") for k, i in enumerate(order)]
    return df.select(F.col(id_col).alias("id"), *units).mapInArrow(make, schema)


def with_known(df: DataFrame, terms: list[Column | Grams], vocabularies: list[list], add, fields: T.StructType) -> DataFrame:
    """Every row of ``df`` with the columns ``fields``, which ``add`` makes from the rows' TF-IDF entries.

    ``vocabularies``: bounded lists ``(term, idf)``, part of a fitted model.  ``add(rows, row, number, weight)`` gets a block
    of rows: their entries by row and term, numbered through all vocabularies; each vocabulary's weights have unit length.
    """
    grams = [listed(t) for t in terms]
    words = [isinstance(df.select(g.units.alias("u")).schema["u"].dataType, T.ArrayType) for g in grams]
    models = [Known(v, g, w) for v, g, w in zip(vocabularies, grams, words, strict=True)]
    model = df.sparkSession.sparkContext.broadcast(models)
    own = df.columns

    def make(batches):
        import pyarrow as pa
        for t in _tables(batches, every=True, bound=KNOWN_UNITS):
            n, parts, at = t.num_rows, [], 0
            for i, known in enumerate(model.value):
                row, number, tf = known.found(t.select([f"_u{i}"]))
                w = tf * known.idf[number]
                parts.append((row, number + at, w / np.sqrt(np.bincount(row, weights=w * w, minlength=n))[row]))
                at += len(known.terms)
            row, number, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.argsort(row, kind="stable")
            made = add(n, row[by], number[by], weight[by])
            yield from pa.table([*[t.column(i) for i in range(len(own))], *made], names=[*own, *fields.names]).to_batches(1 << 12)
    bound_batches(df.sparkSession)
    units = [g.units.alias(f"_u{i}") for i, g in enumerate(grams)]
    return df.select("*", *units).mapInArrow(make, T.StructType([*df.schema.fields, *fields.fields]))


# Labels whose sums a task holds before it hands on what it has.
HELD_LABELS = 64


def known_sums(df: DataFrame, label_cols: list[str], terms: Column | Grams, vocabulary: DataFrame, sublinear: bool) -> DataFrame:
    """``(axis, class, term, w, c)``: for every label column (``axis``: its place) and label the sums of its rows' TF-IDF
    weights and counts, over a vocabulary ``(term, idf)`` of a bounded size.  Null labels do not count.

    The vocabulary goes to every task; rows are summed where they are read, so that a task hands on a row a label and term.
    """
    grams = listed(terms)
    words = isinstance(df.select(grams.units.alias("u")).schema["u"].dataType, T.ArrayType)
    model = df.sparkSession.sparkContext.broadcast(Known([tuple(r) for r in vocabulary.select("term", "idf").collect()], grams, words))
    n_axes = len(label_cols)

    def add(batches):
        import pyarrow as pa
        known, held = model.value, {}
        names, size = pa.array(known.terms, pa.string()), max(1, len(known.terms))

        def rows():
            for (axis, label), (w, c) in held.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), axis), pa.int32()), pa.array([label] * len(at), pa.string()),
                                                  names.take(pa.array(at)), pa.array(w[at]), pa.array(c[at])], names=["axis", "class", "term", "w", "c"])
        for t in _tables(batches, bound=KNOWN_UNITS):
            row, number, tf = known.found(t)
            weight = ((1.0 + np.log(tf)) if sublinear else tf) * known.idf[number]
            weight = weight / np.sqrt(np.bincount(row, weights=weight * weight, minlength=t.num_rows))[row]
            for axis in range(n_axes):
                coded = t.column(axis).combine_chunks().dictionary_encode()
                code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[row]
                for i, label in enumerate(coded.dictionary.to_pylist()):
                    own = code == i
                    w, c = held.setdefault((axis, label), (np.zeros(size), np.zeros(size)))
                    w += np.bincount(number[own], weights=weight[own], minlength=size)
                    c += np.bincount(number[own], weights=tf[own], minlength=size)
            if len(held) > HELD_LABELS:
                yield from rows()
                held.clear()
        yield from rows()
    bound_batches(df.sparkSession)
    labels = [F.col(c).cast("string").alias(f"_l{i}") for i, c in enumerate(label_cols)]
    part = df.select(*labels, grams.units.alias("_units")).mapInArrow(add, "axis int, class string, term string, w double, c double")
    return part.groupBy("axis", "class", "term").agg(F.sum("w").alias("w"), F.sum("c").alias("c"))


class Flags(NamedTuple):
    """For sums by label: which terms are asked for, those that some label's rows hold in at least its share."""
    rows: dict    # of each label
    shares: dict


def stored_blocks(df: DataFrame, id_col: str, terms: Column | Grams) -> DataFrame:
    """Blocks of rows, written once: ``(ids, block, units, value)``; the value holds the rows' units as numbers."""
    grams, spark = listed(terms), df.sparkSession
    schema = T.StructType([T.StructField("ids", T.ArrayType(_id_field(df, id_col).dataType))]).add("block", T.LongType()).add(
        "units", T.LongType()).add("value", T.BinaryType())

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 32
        for i, t in enumerate(_tables(batches)):
            code, length, names = _coded(t.column("_units"))
            value = _shut(code, length, *_text_parts(names))
            yield pa.RecordBatch.from_arrays([lists(t.column("id").combine_chunks(), [t.num_rows]), pa.array([first + i], pa.int64()),
                                              pa.array([len(code)], pa.int64()), pa.array([value], pa.binary())],
                                             names=["ids", "block", "units", "value"])
    path = f"{checkpoint_dir(spark).rstrip('/')}/term-blocks-{uuid.uuid4().hex}"
    _source(df, id_col, grams.units).mapInArrow(pack, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _restored(value: bytes, grams: Grams) -> Counted:
    code, length, size, data = _opened(value)
    return _counted(code.astype(np.int64), length.astype(np.int64), _strings(size, data), grams)


def _answers(blocks: DataFrame, grams: Grams, n: int, only: DataFrame | None, flags: Flags | None) -> DataFrame:
    """``(block, bucket, value)``: to each of a block's terms, in the order it asked, the number of rows that hold it in
    all blocks: 0 if it is not in ``only``, below 0 if ``flags`` ask for it."""
    codes = {label: i for i, label in enumerate(flags.rows)} if flags else {}

    def ask(batches):
        for b in batches:
            for i in range(b.num_rows):
                c = _restored(b.column("value")[i].as_py(), grams)
                size = len(c)
                counts = [np.bincount(c.number, minlength=size)]
                if flags:  # rows of each label that hold a term: how many labels, which, how many rows
                    own = np.array([codes.get(x, -1) for x in b.column("ids")[i].values.to_pylist()], np.int64)[c.row]
                    pairs, rows = np.unique((c.number * (len(codes) + 1) + own)[own >= 0], return_counts=True)
                    of = np.bincount(pairs // (len(codes) + 1), minlength=size)
                    counts += [of, (of, pairs % (len(codes) + 1)), (of, rows)]
                yield from _requests(b.column("block")[i].as_py(), c, n, counts)

    def answer(table, kept=None):
        import pyarrow as pa
        import pyarrow.compute as pc
        if not table.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "value": pa.array([], pa.binary())})
        counts, sizes, code, names = _met(table)
        df = np.bincount(code, weights=np.concatenate([c[0] for c in counts]), minlength=len(names)).astype(np.int64)
        if flags:
            of, label, rows = (np.concatenate([c[i] for c in counts]).astype(np.int64) for i in (1, 2, 3))
            pairs, at = np.unique(np.repeat(code, of) * max(1, len(codes)) + label, return_inverse=True)
            label = pairs % max(1, len(codes))
            held = np.bincount(at, weights=rows, minlength=len(pairs))
            least = np.array([flags.rows[x] * flags.shares[x] for x in codes])
            asked = np.unique(pairs[held >= least[label]] // max(1, len(codes))) if len(pairs) else pairs
            df[asked] = -df[asked]
        if kept is not None:
            df[~pc.is_in(names, value_set=kept.column("term").combine_chunks()).to_numpy(zero_copy_only=False)] = 0
        total, end = df[code], np.cumsum(sizes)
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                         "value": pa.array([_shut(total[z - k:z]) for k, z in zip(sizes, end, strict=True)], pa.binary())})
    schema = "block long, bucket int, value binary"
    asked = blocks.select("ids", "block", "value").mapInArrow(ask, _REQUEST).groupBy("bucket")
    if only is None:
        return asked.applyInArrow(lambda t: answer(t), schema)

    def deal(batches):
        import pyarrow as pa
        for b in batches:
            cut = [t.split(grams.joint) if grams.joint else [t] if grams.high == 1 else list(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_bucket(c, n) for c in cut], pa.int32()), b.column(0)], names=["bucket", "term"])
    kept = only.select("term").mapInArrow(deal, "bucket int, term string")
    return asked.cogroup(kept.groupBy("bucket")).applyInArrow(lambda left, right: answer(left, right), schema)


def all_vectors(df: DataFrame, id_col: str, terms: Column | Grams, n_docs: int, sublinear: bool, min_df: int = 1, max_df: float = 1.0,
                places: int | None = None, namespace: str | None = None, sum_by: str | None = None, only: DataFrame | None = None,
                flags: Flags | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """``(id, terms, weights)`` over a vocabulary of any size (``only``: over the terms of that table).

    Blocks are written once, as numbers (``blocks``: as ``stored_blocks`` did).  Their distinct terms meet in buckets to
    add up the rows that hold them, and each block gets back its own terms' numbers, so that neither the rows' terms nor
    the vocabulary are shuffled or broadcast; what a block and a bucket exchange is one packed value each way.
    With ``sum_by`` the result is ``(<sum_by>, term, weight)`` instead, the weights of a block's rows summed by that column
    (``flags``: of these terms only).
    """
    plain = listed(terms)._replace(units=None)
    field = _id_field(df, sum_by or id_col)
    blocks = stored_blocks(df, sum_by or id_col, terms) if blocks is None else blocks
    units = blocks.agg(F.sum("units")).first()[0] or 0
    n = max(1, math.ceil(units * (plain.high - plain.low + 1) / BUCKET_TERMS))
    answers = _answers(blocks, plain, n, only, flags)
    out = T.StructType([field, T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    if sum_by:
        out = T.StructType([T.StructField(sum_by, field.dataType), T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])

    def weigh(left, right):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        if not left.num_rows or not right.num_rows:
            return to_arrow_schema(out).empty_table()
        ids = left.column("ids").combine_chunks().flatten()
        c = _restored(left.column("value")[0].as_py(), plain)
        total = np.empty(len(c), np.int64)
        total[np.argsort(c.buckets(n), kind="stable")] = np.concatenate([_opened(v)[0] for v in right.sort_by("bucket").column("value").to_pylist()])
        asked, total = total < 0 if flags else np.ones(len(c), bool), np.abs(total)
        has = (total > 0) & (total >= min_df) & (total <= n_docs * max_df)
        idf = np.log((n_docs + 1) / (total + 1)) + 1
        of, numbers, tfs, rows, names = c.row, c.number, c.tf, len(ids), c.terms()
        del c
        if not has.all():
            keep = np.flatnonzero(has[numbers])
            of, numbers, tfs = of[keep], numbers[keep], tfs[keep]
        if not sum_by:
            return _vectors(ids, rows, names, idf, of, numbers, tfs, sublinear, places, namespace)
        w = ((1.0 + np.log(tfs)) if sublinear else tfs) * idf[numbers]
        w = w / np.sqrt(np.bincount(of, weights=w * w, minlength=rows))[of]
        keep = np.flatnonzero(asked[numbers])
        of, numbers, w = of[keep], numbers[keep], w[keep]
        groups = ids.dictionary_encode(null_encoding="encode")
        code = groups.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, inverse = np.unique(code[of] * max(1, len(names)) + numbers, return_inverse=True)
        return pa.table({sum_by: groups.dictionary.take(pa.array(pairs // max(1, len(names)))), "term": names.take(pa.array(pairs % max(1, len(names)))),
                         "weight": np.bincount(inverse, weights=w, minlength=len(pairs)).astype(np.float64)})
    return blocks.select("ids", "block", "value").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(weigh, out)
