"""BPE encoding and decoding through a minimal acyclic transducer (operator 1).

Words that are frequent in the corpus are compiled, with their token ids as output, into a
minimal acyclic automaton: states with the same future are shared, so common endings are
stored once.  Each arc carries the number of words that sort before it; their sum along a
path is the word's number, which points to its ids.  The automaton is one flat file that
workers map into memory.  A word that the lexicon lacks is merged by rank, exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
import tempfile
import unicodedata
from bisect import bisect_left
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from ticketlake.llm.common import (Memo, byte_alphabet, digest_of, documents, frequent_terms, id_text, map_texts,
                                   read_vocabulary, special_splitter, stage, term_counts, worker_state)

# The lexicon holds the words that make up at least 1/LEXICON_WORDS of all words, so at most that many.
LEXICON_WORDS = 1 << 19
# Words and chunks whose ids a worker remembers (in two generations), and up to which length.
MEMO_WORDS = 100_000
# The same where nothing but digests leaves the worker.
MEMO_DIGEST = 250_000
# Up to this many letters a word's pairs are looked through again after each merge; beyond, a heap orders them.
SHORT_WORD = 24
NEVER = 1 << 60

ODD_SPACE = re.compile("[\x1c-\x1f]").search

# Fixed value: the vocabulary's word pattern, with Unicode white space spelled out.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


class WordBpe:
    """A word-level BPE vocabulary (lower-cased, white space dropped, word-end suffix)."""

    def __init__(self, spec: bytes):
        j = json.loads(spec)
        model = j["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        v = self.vocab
        self.joined = {v[a] << 20 | v[b]: i << 20 | v[a + b] for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        self.sections = special_splitter(list(self.special))
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.single = [v[self.letters[b]] for b in range(256)]
        self.closing = [v[self.letters[b] + self.suffix] for b in range(256)]
        self.find = regex.compile(WORD_PATTERN).findall
        self.pieces = {i: p for p, i in self.vocab.items()} | {i: c for c, i in self.special.items()}

    def chunks(self, section: str) -> list[str]:
        """Normalised runs between white space (NFC, lower case character by character); no
        word spans two.  U+001C to U+001F separate for ``split()`` but not for the vocabulary."""
        if not section.isascii():
            section = unicodedata.normalize("NFC", section).replace("Σ", "σ")
        section = section.lower()
        if ODD_SPACE(section):
            return self.find(section)
        return section.split()

    def split(self, text: str) -> list[str]:
        """The chunks of all sections (special strings stand between sections)."""
        if "<" not in text:
            return self.chunks(text)
        return [c for part, _ in self.sections(text) for c in self.chunks(part)]

    def merge(self, word: str) -> tuple[int, ...]:
        """The exact ids of one word: the lowest-ranked pair merges first, the leftmost of equals."""
        b = word.encode()
        n, rank = len(b), self.ranks
        if not n:
            return ()
        if n <= SHORT_WORD:
            ids = list(map(self.single.__getitem__, b))
            ids[-1] = self.closing[b[-1]]
            return self.merge_short(ids)
        parts: list[str | None] = [self.letters[x] for x in b]
        parts[-1] += self.suffix
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := left[i]) >= 0 and (r := rank.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return tuple(self.vocab[p] for p in parts if p is not None and p in self.vocab)

    def merge_short(self, ids: list[int]) -> tuple[int, ...]:
        """As ``merge``, over ids; ``self.joined`` holds rank and product of a pair in one number."""
        get = self.joined.get
        found = [get(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best == NEVER:
                break
            i = found.index(best)
            new = best & 0xFFFFF
            ids[i:i + 2] = [new]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << 20 | new, NEVER)
            if i < len(found):
                found[i] = get(new << 20 | ids[i + 1], NEVER)
        return tuple(ids)

    def decode(self, ids) -> str:
        """The pieces joined by one space, special ones included: this vocabulary names no decoder."""
        get = self.pieces.get
        return " ".join([p for i in ids if (p := get(i)) is not None])


# ---------------------------------------------------------------------------------
# The automaton
# ---------------------------------------------------------------------------------

def compile_lexicon(entries: list[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """Flat minimal acyclic transducer of ``(word, ids)`` entries.

    Words are added in byte order; once a word branches off, the states of the previous
    word's tail can no longer change and are replaced by an equal state where one exists.
    """
    entries = sorted(dict(entries).items())
    arcs: list[list[tuple[int, int]]] = [[]]  # of each state under construction: (label, target)
    final: list[bool] = [False]
    known: dict[tuple, int] = {}
    path = [0]  # states along the previous word
    before = b""

    def close(depth: int) -> None:
        for d in range(len(path) - 1, depth, -1):
            s = path[d]
            key = (final[s], tuple(arcs[s]))
            same = known.setdefault(key, s)
            if same != s:
                arcs[path[d - 1]][-1] = (arcs[path[d - 1]][-1][0], same)
            path.pop()

    for word, _ in entries:
        d = 0
        while d < min(len(word), len(before)) and word[d] == before[d]:
            d += 1
        close(d)
        for c in word[d:]:
            arcs.append([])
            final.append(False)
            arcs[path[-1]].append((c, len(arcs) - 1))
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        before = word
    close(0)
    reach, order, stack = {}, [], [(0, False)]
    while stack:  # words below each state, children first
        s, done = stack.pop()
        if done:
            reach[s] = final[s] + sum(reach[t] for _, t in arcs[s])
            order.append(s)
        elif s not in reach:
            reach[s] = 0
            stack.append((s, True))
            stack += [(t, False) for _, t in arcs[s] if t not in reach]
    order = list(dict.fromkeys(reversed(order)))
    number = {s: i for i, s in enumerate(order)}
    first, label, target, add = [], [], [], []
    for s in order:
        first.append(len(label))
        skipped = int(final[s])
        for c, t in arcs[s]:
            label.append(c)
            target.append(number[t])
            add.append(skipped)
            skipped += reach[t]
    first.append(len(label))
    ids = [i for _, x in entries for i in x]
    starts = np.concatenate([[0], np.cumsum([len(x) for _, x in entries])]) if entries else np.zeros(1)
    parts = [np.asarray(first, "<i4"), np.asarray(label, "<i4"), np.asarray(target, "<i4"), np.asarray(add, "<i4"),
             np.asarray([final[s] for s in order], "<i4"), starts.astype("<i4"), np.asarray(ids, "<i4")]
    return struct.pack("<7i", *[len(p) for p in parts]) + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """Read-only lookups in a compiled lexicon mapped from a file."""

    def __init__(self, path: str):
        flat = np.memmap(path, dtype="<i4", mode="r")
        sizes, at, parts = flat[:7].tolist(), 7, []
        for n in sizes:
            parts.append(memoryview(flat[at:at + n]))
            at += n
        self.first, self.label, self.target, self.add, self.final, self.starts, self.ids = parts
        self.states, self.words = len(self.final), len(self.starts) - 1

    @classmethod
    def mapped(cls, blob: bytes) -> Lexicon:
        """Map ``blob`` from a file of this machine, written once by whichever worker comes first."""
        path = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha256(blob).hexdigest()[:24]}.bin")
        if not os.path.exists(path):
            fd, new = tempfile.mkstemp(dir=tempfile.gettempdir())
            with os.fdopen(fd, "wb") as f:
                f.write(blob)
            os.replace(new, path)
        return cls(path)

    def get(self, word: bytes) -> tuple[int, ...] | None:
        first, label, target, add = self.first, self.label, self.target, self.add
        s = n = 0
        for c in word:
            end = first[s + 1]
            a = bisect_left(label, c, first[s], end)
            if a == end or label[a] != c:
                return None
            n += add[a]
            s = target[a]
        if not self.final[s]:
            return None
        return tuple(self.ids[self.starts[n]:self.starts[n + 1]])


class LexiconEncoder:
    """Encodes whole texts: lexicon first, exact merging for words that it lacks."""

    def __init__(self, spec: bytes, blob: bytes, memo: int = MEMO_WORDS):
        self.bpe, self.lexicon = WordBpe(spec), Lexicon.mapped(blob)
        self.words = Memo(self.word, memo)
        self.of = Memo(self.chunk, memo)
        self.said = Memo(self.chunk_texts, memo)

    def word(self, w: str) -> tuple[int, ...]:
        ids = self.lexicon.get(w.encode())
        return self.bpe.merge(w) if ids is None else ids

    def chunk(self, chunk: str) -> tuple[int, ...]:
        if chunk.isascii() and chunk.isalpha():
            return self.words[chunk]
        return tuple(chain.from_iterable(map(self.words.__getitem__, self.bpe.find(chunk))))

    @classmethod
    def kept(cls, spec: bytes, blob: bytes, memo: int = MEMO_WORDS) -> LexiconEncoder:
        """The worker's encoder; its memos go on from task to task."""
        return worker_state((cls.__name__, memo, digest_of(spec), digest_of(blob)), lambda: cls(spec, blob, memo))

    def chunk_texts(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids of a chunk, the ids as decimals, and their decoded text, both joined by spaces."""
        ids = self.chunk(chunk)
        return len(ids), " ".join(map(str, ids)), self.bpe.decode(ids)

    def texts(self, text: str) -> tuple[int, str, str]:
        """As ``chunk_texts``, for a whole text."""
        of = self.said.__getitem__
        if "<" not in text:
            parts = list(map(of, self.bpe.chunks(text)))
        else:
            parts = []
            for part, special in self.bpe.sections(text):
                parts += map(of, self.bpe.chunks(part))
                if special is not None:
                    number = self.bpe.special[special]
                    parts.append((1, str(number), self.bpe.decode((number,))))
        if not parts:
            return 0, "", ""
        n, ids, said = zip(*parts, strict=True)
        total = sum(n)
        if 0 in n:  # chunks without a token leave no space
            ids, said = filter(None, ids), filter(None, said)
        return total, " ".join(ids), " ".join(said)

    def encode(self, text: str) -> list[int]:
        bpe, of = self.bpe, self.of.__getitem__
        if "<" not in text:
            return list(chain.from_iterable(map(of, bpe.chunks(text))))
        out: list[int] = []
        for part, special in bpe.sections(text):
            out.extend(chain.from_iterable(map(of, bpe.chunks(part))))
            if special is not None:
                out.append(bpe.special[special])
        return out


# ---------------------------------------------------------------------------------
# Operators
# ---------------------------------------------------------------------------------

def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """Count the words of all texts on the executors and compile the frequent ones."""
    vocabulary = read_vocabulary(docs.sparkSession, path)
    texts = id_text(docs.selectExpr("CAST(NULL AS BIGINT) doc_id", f"`{text_col}` text"))
    counts = stage(word_counts(texts, vocabulary))
    bpe = WordBpe(vocabulary.value)
    return compile_lexicon([(w.encode(), bpe.merge(w)) for w, _ in frequent_terms(counts, words)])


def word_counts(texts: DataFrame, vocabulary) -> DataFrame:
    """``(term, n)``: tasks count chunks and take them apart into words only when they hand them on."""
    def make():
        bpe = worker_state(("WordBpe", digest_of(vocabulary.value)), lambda: WordBpe(vocabulary.value))
        return bpe.split, bpe.find
    return term_counts(texts, make)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
               lexicon: bytes | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)``: ids of each whole text; null and empty texts give an empty array."""
    spark = docs.sparkSession
    vocabulary = read_vocabulary(spark, path)
    blob = spark.sparkContext.broadcast(build_lexicon(docs, path, text_col) if lexicon is None else lexicon)

    def make():
        enc = LexiconEncoder.kept(vocabulary.value, blob.value)
        return lambda ids, texts: {"doc_id": ids, "ids": [enc.encode(t) for t in texts]}
    return map_texts(id_text(docs, id_col, text_col), make, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)``: the text of an id array; null and empty arrays give the empty text, unknown ids nothing."""
    vocabulary = read_vocabulary(encoded.sparkSession, path)

    def make():
        bpe = WordBpe(vocabulary.value)
        return lambda keys, ids: {"doc_id": keys, "text": [bpe.decode(x or ()) for x in ids]}
    return map_texts(encoded.selectExpr(f"CAST(`{id_col}` AS BIGINT) doc_id", f"`{ids_col}` ids"), make,
                     "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   lexicon: bytes | None = None) -> DataFrame:
    """Encode, decode and digest each whole text without writing the ids out.

    One row a document, repeated rows included: ``doc_id, n_tokens, ids_sha256,
    decoded_sha256``.  Null text counts as empty (0 tokens, digests of the empty string);
    a null doc_id stays null.  No length limit; an empty table gives no rows; further columns
    are not looked at.
    """
    spark = docs.sparkSession
    vocabulary = read_vocabulary(spark, path)
    blob = spark.sparkContext.broadcast(build_lexicon(docs, path, text_col) if lexicon is None else lexicon)

    def make():
        enc = LexiconEncoder.kept(vocabulary.value, blob.value, MEMO_DIGEST)
        sha = hashlib.sha256

        def run(keys, texts):
            n, a, b = [], [], []
            for t in texts:
                count, ids, said = enc.texts(t)
                n.append(count)
                a.append(sha(ids.encode()).hexdigest())
                b.append(sha(said.encode()).hexdigest())
            return {"doc_id": keys, "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}
        return run
    return map_texts(id_text(docs, id_col, text_col), make,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
