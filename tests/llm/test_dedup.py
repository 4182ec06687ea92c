"""Operators 2, 8 and 10 against brute force."""

from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash

from tests.conftest import SF_SMALL
from tests.llm import common as C
from ticketlake.llm import exact_dedup as X
from ticketlake.llm import simhash as S
from ticketlake.llm import suffix_dedup as R


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 500, 3000)]
    parts.append(np.concatenate([parts[1][:50]] * 300))
    for bits in (0, 3):
        total: dict[int, int] = {}
        back: dict[int, int] = {}
        for p in parts:
            x, n = np.unique(p, return_counts=True)
            for seg in np.unique(x >> np.uint64(64 - bits)) if bits else [0]:
                mine = (x >> np.uint64(64 - bits)) == seg if bits else np.ones(len(x), bool)
                y, m = X.unpack_filter(X.pack_filter(x[mine], n[mine], bits), int(seg))
                assert (y == x[mine]).all() and (m == n[mine]).all()
                for a, b in zip(y.tolist(), m.tolist(), strict=True):
                    back[a] = back.get(a, 0) + b
            for a in p.tolist():
                total[a] = total.get(a, 0) + 1
        assert back == total


def test_exact_duplicates(spark):
    rows = C.edge_rows()
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    got = sorted(map(tuple, X.exact_duplicates(C.docs(spark)).collect()), key=repr)
    assert got == sorted(want, key=repr)
    assert X.exact_duplicates(C.empty(spark)).count() == 0


def test_exact_duplicates_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    df = X.op2_exact_dedup(spark, SF_SMALL).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(X.OP2_SQL).fetchall())


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    """With a fingerprint that always collides the byte comparison alone decides."""
    monkeypatch.setattr(X.F, "xxhash64", lambda *c: X.F.lit(7).cast("long"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in X.exact_duplicates(C.frame(spark, [(1, "a"), (2, "b"), (3, "a")])).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints: dict[int, int], bits: int = 2) -> dict[int, int]:
    up = {i: i for i in prints}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_groups(spark):
    rows = C.edge_rows()
    prints = {i: fingerprint(t) for i, t in rows if i is not None}
    comp = components(prints)
    by_print = {fp: comp[i] for i, fp in prints.items()}
    want = [(i, f"{fingerprint(t):016x}", by_print.get(fingerprint(t))) for i, t in rows]
    got = sorted(map(tuple, S.simhash_groups(C.docs(spark)).collect()), key=repr)
    assert got == sorted(want, key=repr)
    assert S.simhash_groups(C.empty(spark)).count() == 0


@pytest.mark.parametrize("node_rows", [S.NODE_ROWS, 60])
@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_trie_join_finds_every_link(spark, monkeypatch, node_rows, bits):
    monkeypatch.setattr(S, "NODE_ROWS", node_rows)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    sets = [base, (np.uint64(0xABCDEF) << np.uint64(40)) | rng.integers(0, 1 << 9, 200, dtype=np.uint64)]
    for k in range(1, 4):
        x = base.copy()
        for _ in range(k):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
        sets.append(x)
    fp = np.unique(np.concatenate(sets))
    df = spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(fp.view(np.int64))], "id long, fp long")
    want = {(i, i + 1 + int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i + 1:] ^ fp[i]) <= bits)}
    assert {tuple(r) for r in S.links(df, bits).collect()} == want
    forest = [tuple(r) for r in S.links(df, bits, forest=True).collect()]
    assert set(forest) <= {(a, b) for a, b in forest if a < b}
    linked = {i: c for i, c in components(dict(enumerate(fp.tolist())), bits).items() if any(i in p for p in want)}
    assert {r.id: r.component_id for r in S.components(spark.createDataFrame(forest, "a long, b long")).collect()} == linked


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1001 + i) for i in range(200)] + [(5, 5)]
    got = {r.id: r.component_id for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(201)}


def repeats(rows, length=50):
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1 if i is not None else 0):
            w = b[s:s + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1 if i is not None else 0):
            if first[b[s:s + length]] < i:
                gone[s:s + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot,step", [(R.HOT_DOCS, R.BLOCK_BYTES), (2, 4096)])
def test_repeats(spark, monkeypatch, hot, step):
    """Also with small blocks, buckets and transforms, and with every shared minimizer taken as hot."""
    monkeypatch.setattr(R, "BLOCK_BYTES", step)
    if step == 4096:
        monkeypatch.setattr(R, "BUCKET_ROWS", 64)
        monkeypatch.setattr(R, "TRANSFORM_BYTES", 500)
    passage = "a passage that several documents share, more than fifty bytes of it, exactly so."
    rows = [*C.edge_rows(), (20, "before " + passage), (21, passage + " after"), (22, passage[10:60]), (23, passage[10:59]),
            (24, passage + passage), (24, passage), (25, "=" * 300), (26, "=" * 70 + "x"), (27, "ab" * 100), (28, "b" + "ab" * 40),
            (29, "\x00" * 90), (30, "y" + "\x00" * 60 + "z")]
    got = sorted(map(tuple, R.remove_repeats(C.frame(spark, rows), hot_docs=hot).collect()), key=repr)
    assert got == repeats(rows)
    assert R.remove_repeats(C.empty(spark)).count() == 0


def test_interval_expansion_against_sorting():
    rng = np.random.default_rng(3)
    for length in (1, 5, 9, 50):
        data = rng.integers(0, 3, 600).astype(np.uint8)
        data[300:400] = data[100:200]
        order, interval = R.expand_intervals(data, length)
        groups: dict[bytes, set] = {}
        for s in range(len(data) - length + 1):
            groups.setdefault(data[s:s + length].tobytes(), set()).add(s)
        found: dict[int, set] = {}
        for place, k in zip(order.tolist(), interval.tolist(), strict=True):
            if place + length <= len(data):
                found.setdefault(k, set()).add(place)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_repeats_are_exchanged_by_block_and_bucket(spark, monkeypatch):
    """Passages are no rows: a block and a bucket exchange at most one value a step, and no join by content is planned."""
    rows = [(i, "".join(chr(97 + (k * k * 7 + k * (j + i % 20)) % 26) for k in range(400) for j in (0, 3))) for i in range(40)]
    sent = []
    monkeypatch.setattr(R, "stage", lambda df: sent.append(df.columns) or df)
    out = R.remove_repeats(C.frame(spark, rows))
    assert sorted(map(tuple, out.collect()), key=repr) == repeats(rows)
    assert sent == [["block", "size", "docs"]]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    some = [np.sort(np.random.default_rng(4).integers(0, 1 << 32, 1000, dtype=np.uint32)), np.zeros(0, "<i8"), np.arange(-5, 5)]
    back = R._unpack(R._pack(R._steps(some[0]), *some[1:]), "<u4 <i8 <i8")
    assert all((a == b).all() and len(a) == len(b) for a, b in zip([R._unsteps(back[0]), *back[1:]], some, strict=True))


def test_minimizers_fill_all_buckets_alike():
    data = np.random.default_rng(6).integers(97, 123, 200_000).astype(np.uint8)
    _, _, h, _ = R.Minimizers().runs(data, np.array([len(data)]))
    _, parts = R._parts(np.sort(R._cell(h, 5)))
    assert len(parts) == 32 and max(b - a for _, a, b in parts) < 1.3 * len(h) / 32


def test_buckets_grow_first_in_number_then_in_size():
    of = {size: 1 << R._bucket_bits(size, 50) for size in (0, 1 << 20, 54_000_000, 864_000_000, 5 << 30, 50 << 30)}
    assert of == {0: 2, 1 << 20: 2, 54_000_000: 16, 864_000_000: 256, 5 << 30: 512, 50 << 30: 4096}
    assert all(size / 16 / n <= R.MOST_ROWS for size, n in of.items())
