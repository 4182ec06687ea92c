"""Blocks of vectors: a product in single precision leaves few pairs, and the ranks stay exact."""

from __future__ import annotations

import numpy as np
import pytest

from ticketlake.operators import vector_blocks as vb


def _brute(q, c, k, own=None):
    s = np.round(q.v @ c.v.T, vb.ROUND)
    if own:
        s[q.ids[:, None] == c.ids[None, :]] = -np.inf
    s[~np.isfinite(s)] = -np.inf
    return {(i, int(j)) for i in range(len(s)) for j in np.argsort(-s[i], kind="stable")[:k] if np.isfinite(s[i, j])}


@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e12, 1e20, 1e200])
def test_ranks_are_those_of_doubles(scale):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 16)) * scale
    v[::7] = v[1]                                # copies: ties go to the smaller id
    v[5] = v[1] * (1 + 1e-13)                    # apart in doubles only
    c = vb.Vectors(np.arange(3000), v)
    q = c.part(np.arange(0, 3000, 20))
    for own in (False, True):
        row, col, _ = vb.best_pairs(q, c, 15, own, strip=7)
        assert set(zip(row.tolist(), col.tolist())) == _brute(q, c, 15, own)


def test_non_finite_and_repeated_ids():
    v = np.random.default_rng(1).normal(size=(50, 4))
    v[3, 0], v[4, 1] = np.nan, np.inf
    c = vb.Vectors(np.sort(np.arange(50) // 2), v)
    row, col, _ = vb.best_pairs(c, c, 5, True)
    assert set(zip(row.tolist(), col.tolist())) == _brute(c, c, 5, True)


def test_few_pairs_are_scored_in_double_precision():
    v = np.random.default_rng(2).normal(size=(20_000, 64))
    c = vb.Vectors(np.arange(20_000), v / np.linalg.norm(v, axis=1)[:, None])
    row, _ = vb._possible(c.part(np.arange(256)), c, 15, True, None)
    assert len(row) < 256 * 30


def test_buckets_are_searched_in_blocks():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(900, 8))
    c, code = vb.Vectors(np.arange(900), v), rng.integers(0, 8, 900)
    q, own = c.part(np.arange(0, 900, 9)), rng.integers(0, 8, 100)
    for flips in ([1, 2, 4], []):
        row, col, value = vb.probe_buckets(q, own, c, code, flips, 5, True)
        looks = [set(int(o) ^ f for f in [0, *flips]) for o in own]
        s = np.round(q.v @ c.v.T, vb.ROUND)
        s[q.ids[:, None] == c.ids[None, :]] = -np.inf
        s[~np.array([[b in look for b in code] for look in looks])] = -np.inf
        want = {(i, int(j)) for i in range(100) for j in np.argsort(-s[i], kind="stable")[:5]}
        assert set(zip(row.tolist(), col.tolist())) == want and np.allclose(value, s[row, col])
