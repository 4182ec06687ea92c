"""Operators 4, 6 and 9 against plain versions of their definitions."""

from __future__ import annotations

import math
import random

import numpy as np

from tests.llm import common as C
from ticketlake.llm import quality as Q
from ticketlake.llm import secret_scan as S
from ticketlake.llm import toxicity as T
from ticketlake.llm.common import Memo
from ticketlake.llm.ftrl import Ftrl


def plain_ftrl(rows, labels, size, alpha, beta, l1, l2, epochs, seed=0):
    """Per-coordinate follow-the-regularised-leader, one number at a time."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        a, b = (0.0, 0.0) if i == size else (l1, l2)
        if abs(z[i]) <= a:
            return 0.0
        return -(z[i] - math.copysign(a, z[i])) / ((beta + math.sqrt(n[i])) / alpha + b)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            row = [*zip(*rows[r], strict=True), (size, 1.0)]
            w = {i: weight(i) for i, _ in row}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in row)))
            for i, x in row:
                g = (p - labels[r]) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return [weight(i) for i in range(size + 1)]


def test_updates_equal_the_plain_form():
    rng = np.random.default_rng(8)
    rows = [(np.sort(rng.choice(30, 6, replace=False)), rng.normal(size=6)) for _ in range(60)]
    y = [float(r[1][0] > 0) for r in rows]
    got = Ftrl(30, alpha=0.3, l1=0.4, l2=0.7).fit(rows, y, 3).weights()
    assert np.allclose(got, plain_ftrl(rows, y, 30, 0.3, 1.0, 0.4, 0.7, 3), atol=1e-9)
    assert (got[:30] == 0).any() and (got[:30] != 0).any()


def test_quality_scores_are_dense_dot_products(spark):
    rng = np.random.default_rng(2)
    w = rng.normal(size=(1 << 12) + 1) * 0.2
    vector = Q.Features(12)
    want = {}
    for i, t in C.edge_rows():
        dense = np.zeros(1 << 12)
        ids, x = vector(t or "")
        dense[ids] = x
        want[i, t] = 1 / (1 + math.exp(-(dense @ w[:-1] + w[-1])))
    got = Q.score_quality(C.docs(spark), w).collect()
    assert np.allclose(sorted(r.score for r in got), sorted(want[i, t] for i, t in C.edge_rows()))


def test_chain_scores_follow_the_chain(spark):
    """Each category's probability from dense weights and the probabilities before it."""
    rng = np.random.default_rng(3)
    size, k = 1 << 10, len(T.CATEGORIES)
    chain = T.Chain(rng.normal(size=(size, k)) * 0.1, np.tril(rng.normal(size=(k, k)), -1), rng.normal(size=k))
    of = Memo(lambda c: T.cells(c, 10), 100)
    want = {}
    for i, t in C.edge_rows():
        dense = np.zeros(size)
        for chunk in set((t or "").split()):
            for c in np.frombuffer(of[chunk], np.int32):
                dense[c] += 1
        p = []
        for j in range(k):
            s = np.log1p(dense) @ chain.weights[:, j] + chain.bias[j] + sum(chain.links[j, i2] * (q - 0.5) for i2, q in enumerate(p))
            p.append(1 / (1 + math.exp(-s)))
        want.setdefault(i, []).append(p)
    got = {}
    for r in T.score_toxicity(C.docs(spark), chain).collect():
        got.setdefault(r.doc_id, []).append([r[c] for c in T.CATEGORIES])
    assert got.keys() == want.keys()
    for i in want:
        assert np.allclose(sorted(got[i]), sorted(want[i]))


def plain_novel(novelty, text, known):
    """Every candidate against every sensitive word and every known span."""
    words = [m.span() for m in S.SENSITIVE.finditer(text)]
    out = []

    def new(a, b):
        free = not any(s < b and a < e for s, _, e in known)
        if b - a >= S.LEAST_CHARS and free and novelty.added(text, a, b) >= S.NOVELTY * (b - a):
            out.append((a, 3, b))
            return True
        return False
    last = None
    for m in S.CANDIDATE.finditer(text):
        a, b = m.span()
        inside = [w for w in words if w[0] < b and w[1] > a]
        before = any(w[1] <= a and a - w[1] <= S.AROUND for w in words)
        after = any(w[0] >= b and w[0] - b <= S.AROUND for w in words)
        goes_on = last is not None and all(c in S.BETWEEN for c in text[last:a])
        found = (before or goes_on or (after and not inside)) and new(a, b)
        if not found and inside:
            first, final = inside[0], inside[-1]
            one = new(a, first[0])
            found = new(final[1], b) or one
        if found:
            last = out[-1][2]
    return out


def test_novel_spans_equal_the_plain_scan():
    rng = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    novelty = S.Novelty(b"the configuration service request handler connection timeout password value")
    total = 0
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 40)):
            parts.append(rng.choice(["password", "secret", "api key", "auth", "token: ", "password=abcdef123", "plain words stand here",
                                     "configuration_service_request", "\n", "\"", " ", "x" * rng.randint(1, 90), "é",
                                     "".join(rng.choice(letters) for _ in range(rng.randint(8, 60))),
                                     "AKIA" + "".join(rng.choice("ABCDEF012345") for _ in range(18))]))
            parts.append(rng.choice([" ", " ", "", "\n", ", "]))
        text = "".join(parts)
        known = S.base_spans(text)
        got = novelty.spans(text, known)
        assert got == plain_novel(novelty, text, known)
        total += len(got)
    assert total > 100


def test_document_scores_word_by_word():
    """One token at a time, with the cell, the class and the slot probabilities written out."""
    from tests.llm.test_filters import small_model
    from ticketlake.llm import lm_score as L
    model, docs, rng = small_model()
    p, lex, n = model.p, model.lexis, model.hidden
    logs = rng.normal(size=len(docs.k)) * 0.1
    want = []
    for start, size in zip(docs.starts, docs.sizes, strict=True):
        h, x, total = np.zeros(n), lex.start, 0.0
        for word in [*docs.stream[start:start + size], len(docs.k) - 1]:
            a, u = p["embed"][x], h @ p["recur"]
            z, r = (1 / (1 + np.exp(-(a[i * n:(i + 1) * n] + u[i * n:(i + 1) * n]))) for i in (0, 1))
            h = (1 - z) * np.tanh(a[2 * n:] + r * u[2 * n:]) + z * h
            k, s = docs.k[word], docs.s[word]
            by_class = h @ p["to_class"] + p["class_bias"]
            at = sum(lex.slots[:k])
            by_slot = (h @ p["to_slot"] + p["slot_bias"])[at:at + lex.slots[k]]
            total += by_class[k] - np.log(np.exp(by_class).sum()) + by_slot[s] - np.log(np.exp(by_slot).sum()) + logs[word]
            x = docs.x[word]
        want.append(total)
    assert np.allclose(L.score(model, docs, logs), want, atol=1e-4)
