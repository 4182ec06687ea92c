"""Scoring one block of queries against one block of vectors.

A product in single precision, with a bound on its error, leaves the few pairs that can be among a query's k
best; only these are scored in double precision, rounded and ranked.
"""

from __future__ import annotations

import numpy as np

ROUND = 9
STRIP, STRIP_SCORES = 256, 1 << 22  # queries of a strip and their scores, at most
PAIRS = 1 << 16         # pairs scored in double precision at once
GROUPS = 256            # least number of columns' groups whose maxima bound the k-th best


def matrix(column) -> np.ndarray:
    """An Arrow column of vectors of one length as doubles."""
    v = column.combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) if len(v) else np.zeros((0, 0))


class Vectors:
    """Vectors in double and, where their lengths allow it, single precision, by ascending id."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        self.norm = np.sqrt(np.einsum("ij,ij->i", v, v))
        self.narrow = bool(np.all(self.norm < 1e15))  # false for non-finite ones too
        self.v32 = v.astype(np.float32) if self.narrow else None
        # of a product: each factor rounded once, each of the sums once more; subnormal ones by less than the last term
        self.slack = (v.shape[1] + 4) * 2.0 ** -23

    def part(self, at) -> Vectors:
        out = object.__new__(Vectors)
        out.ids, out.v, out.norm, out.narrow, out.slack = self.ids[at], self.v[at], self.norm[at], self.narrow, self.slack
        out.v32 = self.v32[at] if self.narrow else None
        return out


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """A bound that at least k scores of each row reach."""
    n, groups = scores.shape[1], max(GROUPS, 4 * k)
    if n >= 8 * groups:
        width = n // groups
        scores = scores[:, :groups * width].reshape(len(scores), width, groups).max(axis=1)
    return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf, scores.dtype)


def _possible(q: Vectors, c: Vectors, k: int, exclude_self: bool, least: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(row, column)`` that can be among a row's k best and reach ``least``."""
    narrow = q.narrow and c.narrow
    with np.errstate(all="ignore"):
        scores = q.v32 @ c.v32.T if narrow else q.v @ c.v.T
        if not narrow:
            scores[~np.isfinite(scores)] = -np.inf
        if exclude_self:
            a, z = np.searchsorted(c.ids, q.ids, "left"), np.searchsorted(c.ids, q.ids, "right")
            for _ in range(int((z - a).max(initial=0))):  # rows that share an id
                own = np.flatnonzero(a < z)
                scores[own, a[own]] = -np.inf
                a[own] += 1
        margin = 1.1 * 10.0 ** -ROUND
        if narrow:
            margin = margin + 2 * (q.slack * q.norm * c.norm.max(initial=0.0) + 1e-30)
        if least is not None and np.all(np.isfinite(least)):
            bound = least - margin
        else:
            bound = _kth(scores, k).astype(np.float64) - margin
            if least is not None:
                bound = np.maximum(bound, least - margin)
        bound = np.maximum(bound, np.finfo(np.float32).min)
        # a margin below the last place of single precision must not be lost
        low = np.nextafter(bound.astype(scores.dtype), scores.dtype.type(-np.inf))
        at = np.flatnonzero(scores >= low[:, None])
    return at // scores.shape[1], at % scores.shape[1]


def best_pairs(q: Vectors, c: Vectors, k: int, exclude_self: bool, least: np.ndarray | None = None, strip: int = STRIP):
    """``(row, column, score)`` of each query's k best vectors, by row and rank; ties: the smaller id.

    ``least``: scores that a query's pairs have to reach to be of use; others may be left out.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(q.ids) and len(c.ids):
        strip = max(1, min(strip, STRIP_SCORES // len(c.ids)))
        for at in range(0, len(q.ids), strip):
            own = slice(at, at + strip)
            row, col = _possible(q.part(own), c, k, exclude_self, None if least is None else least[own])
            value = np.empty(len(row))
            for i in range(0, len(row), PAIRS):
                value[i:i + PAIRS] = np.einsum("ij,ij->i", q.v[at + row[i:i + PAIRS]], c.v[col[i:i + PAIRS]])
            value = np.round(value, ROUND)
            ok = np.flatnonzero(np.isfinite(value))
            out.append(first_k(row[ok] + at, col[ok], value[ok], k))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def first_k(row: np.ndarray, key: np.ndarray, value: np.ndarray, k: int):
    """The k best values of each row, by row and rank; ties: the smaller key."""
    by = np.lexsort((key, -value, row))
    row, key, value = row[by], key[by], value[by]
    first = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) < k)
    return row[first], key[first], value[first]


def probe_buckets(q: Vectors, own: np.ndarray, c: Vectors, code: np.ndarray, flips: list[int], k: int, exclude_self: bool):
    """``(row, vector row, score)``: each query's k best of the buckets that it looks into.

    ``own``: the bucket of a query's first look; further looks are into the buckets that one of ``flips`` (bits) parts
    from it, which keep only what reaches the k-th best of the first.
    """
    order = np.argsort(code, kind="stable")  # ids ascend within a bucket
    code = code[order]
    least = np.full(len(q.ids), -np.inf)
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for look in ([0], flips):
        if not (look and len(own) and len(code)):
            continue
        asking = np.tile(np.arange(len(own)), len(look))
        wanted = np.concatenate([own[:0], *[own ^ flip for flip in look]])
        by = np.argsort(wanted, kind="stable")
        buckets, starts = np.unique(wanted[by], return_index=True)
        got = [found]
        for bucket, a, z in zip(buckets, starts, [*starts[1:], len(by)], strict=True):
            at = order[np.searchsorted(code, bucket, "left"):np.searchsorted(code, bucket, "right")]
            if len(at):
                rows = asking[by[a:z]]
                row, col, value = best_pairs(q.part(rows), c.part(at), k, exclude_self, least[rows])
                got.append((rows[row], at[col], value))
        found = first_k(*(np.concatenate(x) for x in zip(*got, strict=True)), k)
        rows, count = np.unique(found[0], return_counts=True)
        full = rows[count == k]
        least[full] = found[2][np.searchsorted(found[0], full, "right") - 1]
    return found
