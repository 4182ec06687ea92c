"""Operators 1 and 7 against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import common as C
from ticketlake.llm import bpe_lexicon as B
from ticketlake.llm import token_counts as N

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
BITS = ["the", "'s", "'ll", "'r", "'", " ", "  ", "\n", "\t", "İ", "Σ", "ΑΣ ", "é", "ß", "漢字", "🙂", "<|endoftext|>",
        "<|startoftext|>", "<|endo", "!!", "...", "12", "²", "\x1c", "\x85", "====", "    ", "station", "ﬁ", "'VE", " t"]


def texts(n: int, size: int = 12):
    rng = random.Random(3)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): (i, i + 1) for i, w in enumerate(["station", "nation", "nations", "ration", "ring", "king", "a", "ünion"])}
    lex = B.Lexicon.mapped(B.compile_lexicon(list(words.items())))
    assert {w: lex.get(w) for w in words} == words
    assert [lex.get(x) for x in (b"", b"stat", b"kin", b"ringx", b"zz")] == [None] * 5
    # right languages as classes of equal futures: one state each
    futures = {frozenset(w[len(p):] for w in words if w.startswith(p)) for v in words for p in [v[:i] for i in range(len(v) + 1)]}
    assert lex.states == len(futures)
    assert B.Lexicon.mapped(B.compile_lexicon([])).get(b"a") is None


def test_merges_agree_with_library():
    spec = open(WORD, "rb").read()
    lib, bpe = Tokenizer.from_file(WORD), B.WordBpe(spec)
    enc = B.LexiconEncoder(spec, B.compile_lexicon([(w.encode(), bpe.merge(w)) for w in ("the", "station", "ll")]))
    for t in [*texts(1500), "a" * 5000, "ab" * 40]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == ids
        assert bpe.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_prefix_counts_agree_at_every_prefix():
    lib, counter = Tokenizer.from_file(BYTE), N.PrefixCounter(open(BYTE, "rb").read())
    for t in texts(500):
        counts = counter.prefixes(t)
        assert counts.tolist() == [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        fit = N.fit_prefix(counts, 3)
        assert counts[fit] <= 3 and (counts[fit + 1:] > 3).all()


def test_round_trip_rows(spark):
    lib = Tokenizer.from_file(WORD)
    got = sorted(map(tuple, B.bpe_round_trip(C.docs(spark), WORD).collect()), key=repr)
    want = []
    for i, t in C.edge_rows():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert B.bpe_round_trip(C.empty(spark), WORD).count() == 0


def test_encode_and_decode_tables(spark):
    lib = Tokenizer.from_file(WORD)
    encoded = B.bpe_encode(C.docs(spark), WORD)
    back = sorted(map(tuple, B.bpe_decode(encoded, WORD).collect()), key=repr)
    want = [(i, lib.decode(lib.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in C.edge_rows()]
    assert back == sorted(want, key=repr)


def test_prefix_count_rows(spark):
    lib = Tokenizer.from_file(BYTE)
    out = N.prefix_counts(C.docs(spark), BYTE, keep_counts=True)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out.collect()), key=repr)
    want = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in C.edge_rows()]
    assert got == sorted(want, key=repr)
    at = {r.doc_id: r.tokens_at for r in N.tokens_at(out.where("doc_id = 4").withColumn("cut", out.n_bytes * 0 + 20), "cut").collect()}
    assert at == {4: len(lib.encode(dict(C.edge_rows())[4][:20]).ids)}
    assert N.prefix_counts(C.empty(spark), BYTE).count() == 0


@pytest.mark.parametrize("bound", [1, 10])
def test_frequent_terms_keep_their_bound(spark, bound):
    from ticketlake.llm.common import frequent_terms
    counts = spark.createDataFrame([(f"w{i}", 100 // (i + 1)) for i in range(50)], "term string, n long")
    total = sum(100 // (i + 1) for i in range(50))
    got = frequent_terms(counts, bound)
    assert got == sorted(((f"w{i}", 100 // (i + 1)) for i in range(50) if 100 // (i + 1) * bound >= total), key=lambda x: (-x[1], x[0]))
    assert len(got) <= bound


def test_prefixes_are_read_once(monkeypatch):
    """Bytes of known prefixes are not looked at again, and a full trie or table of moves is begun anew with the same counts."""
    spec = open(BYTE, "rb").read()
    lib, counter = Tokenizer.from_file(BYTE), N.PrefixCounter(spec)
    counter.scan(" stationery")
    nodes = len(counter.next)
    counter.scan(" stationed")
    assert len(counter.next) == nodes + 1  # only the last byte is new
    assert counter.prefixes("stationery, stationery.").tolist()[-1] == len(lib.encode("stationery, stationery.").ids)
    monkeypatch.setattr(N, "MEMO_PREFIXES", 20)
    monkeypatch.setattr(N, "MEMO_MOVES", 10)
    monkeypatch.setattr(N, "MEMO_UNITS", 3)
    small = N.PrefixCounter(spec)
    for t in texts(150) + ["stationed" * 9 + "é" * 30]:
        assert small.prefixes(t).tolist() == [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
