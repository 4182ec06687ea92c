"""TF-IDF blocks, mined keywords and the keyword rule against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ticketlake.operators import features as fe
from ticketlake.operators import rules as rl

TEXTS = ["The red red apple, a pear", "blue apple and the pear é", "", None, "the 漢字 apple", "x y z", "red apple"]


def grams_of(text, kind):
    t = (text or "").lower()
    if kind == "char":
        return [t[i:i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)]
    w = [x for x in re.findall(r"\w+", t) if len(x) >= 2]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def plain(texts, kind, sub, min_df, max_df, top):
    tf = [Counter(grams_of(t, kind)) for t in texts]
    df, cf = Counter(g for c in tf for g in c), Counter()
    for c in tf:
        cf.update(c)
    keep = sorted((g for g in df if min_df <= df[g] <= max_df * len(texts)), key=lambda g: (-cf[g], g.encode()))[:top]
    idf = {g: math.log((1 + len(texts)) / (1 + df[g])) + 1 for g in keep}
    out = {}
    for i, c in enumerate(tf):
        w = {g: ((1 + math.log(n)) if sub else n) * idf[g] for g, n in c.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out |= {(i, g): round(x / norm, 9) for g, x in w.items()}
    return out


@pytest.mark.parametrize("kind,sub,min_df,max_df,top,bound", [
    ("word", False, 1, 1.0, None, 10**6), ("word", False, 1, 1.0, None, 0), ("word", True, 2, 0.9, 4, 10**6), ("char", True, 2, 0.95, 30, 10**6)])
def test_weights_equal_the_formula(spark, monkeypatch, kind, sub, min_df, max_df, top, bound):
    monkeypatch.setattr(fe, "BROADCAST_TERMS", bound)
    monkeypatch.setattr(fe, "HOT", 2)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, t string")
    terms = (fe.word_terms if kind == "word" else fe.char_terms)(F.col("t"))
    out = fe.tfidf(df, "k", terms, sub, min_df, max_df, top)
    assert {(r.id, r.term): round(r.weight, 9) for r in out.collect()} == plain(TEXTS, kind, sub, min_df, max_df, top or 10**9)


def test_long_texts_take_linear_time(spark):
    import time
    df = spark.createDataFrame([(1, "abcdefgh " * 20_000)], "k long, t string")
    began = time.time()
    assert fe.tfidf(df, "k", fe.char_terms(F.col("t"))).count() == 27
    assert fe.tfidf(df, "k", fe.word_terms(F.col("t"))).count() == 2
    assert time.time() - began < 60


def test_keyword_table(spark):
    kw = spark.createDataFrame([("b", "red apple"), ("b", "pear"), ("a", "red"), ("a", "blue"), ("c", "the big red")], "class string, ngram string")
    rows = ["Red   apple pear", "a red, apple", "blue red", "nothing", None, "reds", "The big\nred thing", "pear red"]
    df = spark.createDataFrame(list(enumerate(rows)), "k long, t string")
    got = {r.k: (r.rule_label, r.rule_confidence, r.rule_route) for r in rl.keyword_rule_table(df, "k", "t", kw).collect()}
    want = {}
    table = defaultdict(list)
    for c, g in kw.collect():
        table[c].append(g)
    for i, t in enumerate(rows):
        low = " ".join((t or "").lower().split())
        s = {c: sum(bool(re.search(r"\b" + r"\s+".join(g.split()) + r"\b", low)) for g in gs) / len(gs) for c, gs in table.items()}
        best = min(s, key=lambda c: (-s[c], c))
        want[i] = (best, s[best], "auto_route" if s[best] >= 0.9 else "escalate_to_tier2") if s[best] > 0 else (None, None, None)
    assert got == want


def test_keywords_equal_the_definition(spark):
    texts = ["red apple", "red pear pear", "blue car", "blue bus bus", "red car"]
    labels = ["f", "f", "v", "v", "v"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    cls = spark.createDataFrame(list(enumerate(labels)), "id long, c string")
    got = {(r["class"], r.ngram): r.specificity for r in rl.class_keywords(fe.tfidf(df, "k", fe.word_terms(F.col("t"))), cls, "id", "c", 3).collect()}
    w = plain(texts, "word", False, 1, 1.0, 10**9)
    mean = {(c, g): sum(w.get((i, g), 0) for i, lab in enumerate(labels) if lab == c) / labels.count(c) for c in "fv" for _, g in w}
    for (c, g), s in got.items():
        assert abs(s - (mean[c, g] - mean["v" if c == "f" else "f", g])) < 1e-6
    assert len(got) == 6
