"""Exact token counts at every prefix of a text (operator 7).

For a byte string, the encoding of each prefix ends in exactly one token such that the
encoding of what precedes it, followed by that token, is itself an encoding.  Whether a
token may follow another depends on the two alone: no merge across their border may come
before a merge inside them.  So one left-to-right pass gives, for every prefix, its last
token and ``count[i] = count[i - len(last)] + 1``.  Truncation and budget questions are
then look-ups.
"""

from __future__ import annotations

import json
import re
from array import array
from operator import sub

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import (Memo, byte_alphabet, digest_of, documents, id_text, map_texts, read_vocabulary,
                                   special_splitter, worker_state)

TOKEN_LIMIT = 512
MEMO_UNITS = 250_000
MEMO_PAIRS = 500_000
MEMO_PREFIXES = 800_000
PREFIX_BYTES = 40
MEMO_MOVES = 500_000
NEVER = 1 << 60
# Packed differences of the counts of two neighbouring prefixes, from -PREFIX_BYTES on.
PACKED = [array("i", [d]).tobytes() for d in range(-PREFIX_BYTES, PREFIX_BYTES + 1)]

# The contractions of the vocabulary's word pattern.
CONTRACTIONS = frozenset(["s", "t", "re", "ve", "m", "ll", "d"])
# White space and the word after it belong together, since the last blank joins the word.
UNIT_PATTERN = (r"(?:\p{White_Space}*(?!\x20)\p{White_Space})?'(?:s|t|re|ve|m|ll|d)"
                r"|\p{White_Space}*(?:\p{L}+|\p{N}+|[^\p{White_Space}\p{L}\p{N}]+)|\p{White_Space}+")
# No unit spans two of these; U+001C to U+001F count as space here but not for the vocabulary.
CHUNKS = re.compile(r"\s*\S+|\s+").findall
ODD_SPACE = re.compile("[\x1c-\x1f]").search


class PrefixCounter:
    """Prefix counts for a byte-level BPE vocabulary file."""

    def __init__(self, spec: bytes):
        j = json.loads(spec)
        alphabet = byte_alphabet()
        self.ids = {bytes(alphabet[c] for c in piece): i for piece, i in j["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        vocab = j["model"]["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank
        for r, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x, y] = r
            self.made.setdefault(z, (x, y, r))
        # States: beginnings of tokens.  What was read is in the state of its longest end that is one.
        self.heads = {h: i for i, h in enumerate(dict.fromkeys(p[:i] for p in self.ids for i in range(len(p) + 1)))}
        self.names = list(self.heads)
        self.moves: dict[int, int] = {}  # state << 8 | byte -> state
        self.endings: dict[int, tuple] = {}  # state -> the tokens at its end, longest first, each with its size
        self.forget()
        self.ends: dict[int, tuple[list, list]] = {}
        self.pairs: dict[int, bool] = {}  # left << 20 | right
        self.units = Memo(self.steps, MEMO_UNITS)
        self.special = [t["content"] for t in j.get("added_tokens", [])]
        self.blank = self.scan(" ")
        self.sections = special_splitter(self.special)
        self.find = regex.compile(UNIT_PATTERN).findall
        self.space = regex.compile(r"\p{White_Space}*").match

    def borders(self, t: int) -> tuple[list, list]:
        """The tokens at the left and at the right end of ``t`` while it is built, each with
        the rank at which it is merged away (never for ``t`` itself), smallest first."""
        if t not in self.ends:
            sides = []
            for side in (0, 1):
                out, x, gone = [], t, NEVER
                while True:
                    out.append((x, gone))
                    if x not in self.made:
                        break
                    gone = self.made[x][2]
                    x = self.made[x][side]
                sides.append(out[::-1])
            self.ends[t] = tuple(sides)
        return self.ends[t]

    def follows(self, a: int, b: int) -> bool:
        """Whether the tokens ``a b`` are the encoding of their bytes together."""
        key = a << 20 | b
        ok = self.pairs.get(key)
        if ok is None:
            right, left = self.borders(a)[1], self.borders(b)[0]
            i = j = 0
            while True:
                (x, gx), (y, gy) = right[i], left[j]
                r = self.rank.get((x, y))
                if r is not None and r < gx and r <= gy:  # of equal ranks the leftmost merges first
                    ok = False
                    break
                if gx == NEVER and gy == NEVER:
                    ok = True
                    break
                if gx <= gy:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def move(self, key: int) -> int:
        """The state after one more byte; ``key``: state << 8 | byte."""
        s = self.names[key >> 8] + bytes([key & 0xFF])
        while s not in self.heads:
            s = s[1:]
        if len(self.moves) >= MEMO_MOVES:
            self.moves.clear()
        self.moves[key] = self.heads[s]
        return self.heads[s]

    def ending(self, state: int) -> tuple:
        """``(token, size)`` of the tokens that a state ends in, longest first."""
        s = self.names[state]
        found = tuple((self.ids[s[i:]], len(s) - i) for i in range(len(s)) if s[i:] in self.ids)
        self.endings[state] = found
        return found

    def forget(self) -> None:
        """The known prefixes of words as a trie: node 0 is the empty one; of each
        node the state, last token and count, and the packed differences of the counts up to it."""
        self.next: dict[int, int] = {}  # node << 8 | byte -> node
        self.states, self.last, self.count, self.packed = [0], [-1], [0], [b""]

    def grow(self, b: bytes, path: list[int]) -> None:
        """New nodes for the bytes of ``b`` after those that ``path`` has nodes of."""
        states, last, count, packed, add = self.states, self.last, self.count, self.packed, path.append
        moves, endings, pairs = self.moves.get, self.endings.get, self.pairs.get
        node = path[-1]
        state = states[node]
        for byte in b[len(path) - 1:]:
            move = state << 8 | byte
            state = moves(move)
            if state is None:
                state = self.move(move)
            for t, size in endings(state) or self.ending(state):
                before = path[-size]
                if not before:
                    break
                ok = pairs(last[before] << 20 | t)
                if ok or ok is None and self.follows(last[before], t):
                    break
            n = count[before] + 1
            packed.append(packed[node] + PACKED[n - count[node] + PREFIX_BYTES])
            key, node = node << 8 | byte, len(states)
            self.next[key] = node
            states.append(state)
            last.append(t)
            count.append(n)
            add(node)

    def long(self, b: bytes) -> list[int]:
        """Token count of each prefix, the empty one first, of a word too long for the trie."""
        last, count, state = [-1], [0], 0
        for byte in b:
            key = state << 8 | byte
            state = self.moves.get(key)
            if state is None:
                state = self.move(key)
            for t, size in self.endings.get(state) or self.ending(state):
                if size == len(last) or self.follows(last[-size], t):
                    break
            last.append(t)
            count.append(count[-size] + 1)
        return count

    def walk(self, b: bytes) -> list[int]:
        """The nodes of the prefixes of a word of at most ``PREFIX_BYTES`` bytes."""
        if len(self.next) > MEMO_PREFIXES:
            self.forget()
        known, node, path = self.next.get, 0, [0]
        add = path.append
        for byte in b:
            node = known(node << 8 | byte)
            if node is None:
                self.grow(b, path)
                break
            add(node)
        return path

    def scan(self, s: str) -> list[int]:
        """Token count of each character prefix (1, 2, ... characters) of one word."""
        b = s.encode()
        if len(b) > PREFIX_BYTES:
            count = self.long(b)
        else:
            path = self.walk(b)  # may begin the trie anew
            count = list(map(self.count.__getitem__, path))
        if len(s) == len(b):
            return count[1:]
        return [count[i] for i in range(1, len(b) + 1) if i == len(b) or b[i] & 0xC0 != 0x80]

    def unit(self, u: str) -> list[int]:
        """Token count of each character prefix of white space and the word after it."""
        core = u[self.space(u).end():]
        space = u[:len(u) - len(core)]
        if not core:
            return self.scan(space)
        out, base, lead = [], 0, ""
        if space == " ":
            out, lead = self.blank, " "
        elif space:
            out = self.scan(space)  # a prefix that ends here ends in one run of white space
            if space[-1] == " ":
                lead, base = " ", self.scan(space[:-1])[-1] if len(space) > 1 else 0
            else:
                base = (self.scan(space[:-1])[-1] if len(space) > 1 else 0) + self.scan(space[-1])[-1]
        if core[0] == "'" and core[1:] in CONTRACTIONS and not lead:
            mark, rest = self.scan("'")[-1], self.scan(core[1:])
            inner = [mark, *[mark + x for x in rest[:-1]], self.scan(core)[-1]]
        else:
            inner = self.scan(lead + core)[len(lead):]
        return out + [base + x for x in inner]

    def steps(self, chunk: str) -> bytes:
        """Prefix counts of white space and the run after it, as packed differences."""
        core, ascii_ = chunk[1:] if chunk[0] == " " else chunk, chunk.isascii()
        plain = ascii_ and core.isalpha()
        if not plain:  # one plain word is one unit
            units = self.find(chunk)
            if len(units) > 1:  # each may be known by itself
                return b"".join(map(self.units.__getitem__, units))
            plain = core and core[0] != "'" and not core[0].isspace()
        if plain and ascii_ and len(chunk) <= PREFIX_BYTES:
            path = self.walk(chunk.encode())  # may begin the trie anew
            return self.packed[path[-1]]
        counts = self.scan(chunk) if plain else self.unit(chunk)
        return array("i", map(sub, counts, [0, *counts[:-1]])).tobytes()

    def section(self, s: str) -> np.ndarray:
        return np.cumsum(np.frombuffer(b"".join(map(self.units.__getitem__, self.find(s) if ODD_SPACE(s) else CHUNKS(s))), dtype=np.int32), dtype=np.int64)

    def prefixes(self, text: str) -> np.ndarray:
        """``counts[i]``: exact number of tokens of ``text[:i]``, for i from 0 to the text's length."""
        out, base = [np.zeros(1, dtype=np.int64)], 0
        parts = self.sections(text) if "<" in text else [(text, None)]
        for part, special in parts:
            # up to its last character a special string is ordinary text, which may join the word before it
            counts = self.section(part + special[:-1] if special else part)
            out.append(base + counts)
            if special:
                base += (int(self.section(part)[-1]) if part else 0) + 1
                out.append(np.asarray([base]))
        return np.concatenate(out)


def fit_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that encodes to at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  budget: int = TOKEN_LIMIT, keep_counts: bool = False) -> DataFrame:
    """Token counts of each whole text and its longest prefix within ``budget`` tokens.

    One row a document: ``doc_id, n_bytes, n_tokens, fit_chars`` and, on request,
    ``counts`` (token count of every character prefix, from the empty one on).  Null text
    counts as empty: 0 bytes, 0 tokens.  Texts of any length are counted whole.  A null
    doc_id stays null; repeated rows each give a row; an empty table gives no rows; further
    columns are not looked at.
    """
    vocabulary = read_vocabulary(docs.sparkSession, path)

    def make():
        # one a worker process: its memos go on from task to task
        counter = worker_state(("PrefixCounter", digest_of(vocabulary.value)), lambda: PrefixCounter(vocabulary.value))

        def run(keys, texts):
            out = {"doc_id": keys, "n_bytes": [], "n_tokens": [], "fit_chars": [], "counts": []}
            for t in texts:
                counts = counter.prefixes(t)
                out["n_bytes"].append(len(t.encode()))
                out["n_tokens"].append(int(counts[-1]))
                out["fit_chars"].append(fit_prefix(counts, budget))
                if keep_counts:
                    out["counts"].append(counts.astype(np.int32))
            return out
        return run
    return map_texts(id_text(docs, id_col, text_col), make, "doc_id long, n_bytes long, n_tokens long, fit_chars long"
                     + ", counts array<int>" * keep_counts)


def tokens_at(counted: DataFrame, chars_col: str) -> DataFrame:
    """Adds ``tokens_at``: tokens of the prefix of ``chars_col`` characters (beyond the text: of all of it)."""
    at = F.least(F.greatest(F.col(chars_col), F.lit(0)), F.size("counts") - 1)
    return counted.withColumn("tokens_at", F.element_at("counts", (at + 1).cast("int")))


def op7_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    out = prefix_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fit_chars")
