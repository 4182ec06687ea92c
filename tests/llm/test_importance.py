"""Importance resampling against a plain version; selection and ranks on their own."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import common as C
from ticketlake.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(rows, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for c, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            c.update(zlib.crc32(f.encode()) % 10_000 for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    out, keyed = [], []
    for i, x in rows:
        w, fs = features(x)
        weight = sum(math.floor(1000 * math.log(float(t[b] + 1) * (S + 10_000) / (float(s[b] + 1) * (T + 10_000))))
                     for b in (zlib.crc32(f.encode()) % 10_000 for f in fs))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(fs), weight, score, None])
        if len(w) >= least:
            keyed.append(((-score, i is None, i or 0, len(fs)), len(out) - 1))
    for r, (_, at) in enumerate(sorted(keyed)[:percent * len(keyed) // 100], 1):
        out[at][4] = r
    return sorted(map(tuple, out), key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in df.dtypes} == {"bigint"}
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("percent", [5, 60])
def test_equals_the_plain_version_on_edge_rows(spark, percent):
    rng = random.Random(3)
    rows = C.edge_rows() + [(100 + i, C.prose(rng, rng.randint(15, 90))) for i in range(120)]
    target = [C.prose(rng, 40), None, "", "Ünïque WORDS here"]
    goal = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    assert got(I.importance_draw(C.frame(spark, rows), goal, percent=percent)) == plain(rows, target, percent)


def test_empty_tables(spark):
    goal = spark.createDataFrame([], "item_id long, text string")
    assert got(I.importance_draw(C.empty(spark), goal)) == []
    rows = [(i, C.prose(random.Random(i), 30)) for i in range(40)]
    assert got(I.importance_draw(C.frame(spark, rows), goal)) == plain(rows, [])


def test_pieces_of_a_long_text_give_the_same_features():
    text = "Ab 1 é " * 500 + "z" * 3000 + " end of it"
    whole = Counter(h for _, x in I.feature_hashes(I.word_lists(text)) for h in x.tolist())
    for piece in (1, 2, 7, 100):
        assert Counter(h for _, x in I.feature_hashes(I.word_lists(text, piece)) for h in x.tolist()) == whole
    assert whole == Counter(zlib.crc32(f.encode()) for f in features(text)[1])


@pytest.mark.parametrize("pivots", [1, 4])
def test_kth_key_with_ties(spark, pivots):
    rng = random.Random(pivots)
    values = [(rng.randint(0, 30), 0 if rng.random() < 0.4 else rng.randint(0, 5)) for _ in range(500)]
    rows = spark.createDataFrame(values, "a long, b long").select(F.struct(F.col("a").alias("k0"), F.col("b").alias("k1")).alias("key"))
    for k in (1, 2, 250, 499, 500):
        assert I.kth_key(rows, k, pivots) == sorted(values)[k - 1]
    assert I.kth_key(rows, 501, pivots) is None


def test_ranks_over_several_ranges_and_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(I, "COPIES", 4)
    values = [(i % 50 if i % 3 else 7,) for i in range(400)]
    rows = spark.createDataFrame(values, "v long").select(F.struct(F.col("v").alias("k0")).alias("key"), "v")
    out = I.rank_rows(rows, 400, rank_rows=30).collect()
    assert [r["v"] for r in sorted(out, key=lambda r: r["rank"])] == sorted(v for v, in values)
    assert sorted(r["rank"] for r in out) == list(range(1, 401))
