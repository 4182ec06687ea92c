"""Benchmark decontamination by pigeonhole edit matching (operator 5).

An item that occurs with at most k edits holds at least one of k + 1 pieces of it exactly.
All pieces of a block of items are searched at once (Aho-Corasick); around each hit the
item is matched with Myers' bit-parallel algorithm, and reported if its distance is k or
less.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import benchmark, documents, id_text, map_texts

# Edits allowed as a share of the item's normalised length.
EDIT_RATE = 0.08
# Items are sent out in blocks of at most this many characters; each block is one pass over the documents.
BLOCK_CHARS = 1_000_000

WORDS = re.compile(r"\w+").findall


def normalise(text: str) -> str:
    """Lower case, words joined by one space: punctuation, white space and letter case are no edits."""
    return " ".join(WORDS(text.lower()))


def budget(length: int, rate: float = EDIT_RATE) -> int:
    return int(rate * length)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(pattern_bits: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of ``text``, and where that ends (first such).

    One integer holds the vertical differences of a whole column.  ``anchored``: the
    substring must begin where the text does.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, end = m, 0
    carry = 1 if anchored else 0
    for j, c in enumerate(text, 1):
        eq = pattern_bits.get(c, 0)
        x = eq | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hp = vn | (full & ~(d0 | vp))
        hn = vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1 | carry) & full
        hn = (hn << 1) & full
        vp = hn | (full & ~(d0 | hp))
        vn = hp & d0
        if score < best:
            best, end = score, j
    return best, end


def bits_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class ItemMatcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE):
        self.items = []
        find = ahocorasick.Automaton()
        places: dict[str, list] = {}
        for item_id, raw in items:
            text = normalise(raw)
            if not text:
                continue
            k = budget(len(text), rate)
            n = len(self.items)
            self.items.append((item_id, text, k, bits_of(text), bits_of(text[::-1])))
            for at, piece in pieces(text, k):
                places.setdefault(piece, []).append((n, at))
        for piece, where in places.items():
            find.add_word(piece, (len(piece), where))
        if places:
            find.make_automaton()
        self.find = find if places else None

    def __call__(self, raw: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, start, end, distance)`` in the normalised text: the best match of each item there."""
        if self.find is None:
            return []
        text = normalise(raw)
        found: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, set[int]] = {}
        for last, (length, where) in self.find.iter(text):
            for n, at in where:
                item_id, item, k, bits, back = self.items[n]
                origin = last + 1 - length - at
                if n in found and found[n][2] == 0:
                    continue
                near = tried.setdefault(n, set())
                if origin in near:  # the same alignment was compared at another piece
                    continue
                near.add(origin)
                begin = max(0, origin - k)
                window = text[begin:origin + len(item) + k]
                if origin >= 0 and text.startswith(item, origin):
                    d, end = 0, origin + len(item) - begin
                elif k == 0:
                    continue
                else:
                    d, end = myers(bits, len(item), window)
                if d <= k and (n not in found or d < found[n][2]):
                    # backwards from the end the best beginning
                    _, size = myers(back, len(item), window[:end][::-1], anchored=True) if d else (0, len(item))
                    found[n] = (begin + end - size, begin + end, d)
        return [(self.items[n][0], a, b, d) for n, (a, b, d) in sorted(found.items())]


def item_blocks(items: DataFrame, id_col: str, text_col: str, chars: int) -> list[DataFrame]:
    """The items in blocks of about ``chars`` characters, by hash; nearly always one."""
    total = items.agg(F.sum(F.length(text_col))).first()[0] or 0
    n = -(-int(total) // chars) or 1
    return [items.where(F.pmod(F.xxhash64(id_col), F.lit(n)) == i) for i in range(n)]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """``(doc_id, item_id, start, end, distance)``: every item that a document holds with few enough edits.

    Whole texts are searched; places are characters of the normalised text, and of several
    places of an item the best is given.  Documents without a match give no row.  Null and
    empty texts match nothing, nor do null or empty items; items with equal texts each
    match; repeated rows each give theirs; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    known = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item")).where(
        F.col("item").isNotNull()).distinct()
    out = None
    for block in item_blocks(known, "item_id", "item", BLOCK_CHARS):
        shared = spark.sparkContext.broadcast([tuple(r) for r in block.collect()])  # one block, bounded by its characters

        def make(shared=shared):
            match = ItemMatcher(shared.value, rate)

            def run(ids, texts):
                rows = [(i, *m) for i, t in zip(ids, texts, strict=True) for m in match(t)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                return dict(zip(("doc_id", "item_id", "start", "end", "distance"), map(list, cols), strict=True))
            return run
        part = map_texts(id_text(docs, id_col, text_col), make,
                         "doc_id long, item_id long, start long, end long, distance int")
        out = part if out is None else out.unionByName(part)
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir))
