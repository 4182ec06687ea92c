"""Secret scan: fixed patterns, and zstandard novelty of strings in sensitive places (operator 4).

Beside the three fixed kinds, every string that has a sensitive word in its surroundings, before or
after it and on any line, is a candidate, and so is what follows a reported string without a word
between.  Its novelty is its marginal compressed size: the bytes that it adds to its surroundings when both are compressed with a dictionary of the corpus' own identifiers.
Names and prose nearly vanish in that, keys and passwords do not; candidates that stay
almost as long as they are get reported.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import zstandard
from pyspark.sql import DataFrame, SparkSession

from ticketlake.llm.common import documents, frequent_terms, id_text, map_texts, stage, term_counts

# Identifiers that hold at least 1/IDENTIFIERS of all occurrences prime the compressor: so many, of 40 letters at most.
IDENTIFIERS = 8_192
# Characters of surroundings on each side: for the compression, and for a sensitive word.
AROUND = 256
LEAST_CHARS = 12
# Added bytes a character from which a candidate is incompressible.
NOVELTY = 0.6

# The three base kinds, as the contract words them.
ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_HINTS = ("passw", "secret", "token", "api")

SENSITIVE = re.compile(r"(?i:passw|passphrase|pwd|secret|token|api[_\x20-]?key|access[_\x20-]?key|private[_\x20-]?key|credential|bearer|auth)",
                       re.ASCII)
SENSITIVE_HINTS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=!@#$%^&*~-]{" + f"{LEAST_CHARS},}}")
# What may stand between the lines of one secret.
BETWEEN = " \t\r\n\"'\\,"
# Letters only: a key that many copies repeat must not become a known word.
IDENTIFIER = re.compile(r"[A-Za-z_]{4,40}").findall


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed kinds, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Novelty:
    """Marginal compressed bytes with a primed dictionary."""

    def __init__(self, identifiers: bytes):
        primed = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if identifiers else None
        self.size = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False).compress

    def added(self, text: str, start: int, end: int) -> int:
        before, after = text[max(0, start - AROUND):start].encode(), text[end:end + AROUND].encode()
        return len(self.size(before + after + text[start:end].encode())) - len(self.size(before + after))

    def spans(self, text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Incompressible candidates that overlap no known span."""
        low = text.lower()
        if not any(h in low for h in SENSITIVE_HINTS):
            return []
        places = [m.span() for m in SENSITIVE.finditer(text)]
        if not places:
            return []
        starts, ends = zip(*places, strict=True)
        known_starts = [s for s, _, _ in known]  # ascending
        reach = list(accumulate((e for _, _, e in known), max))  # the last end of the spans so far
        out, last = [], None

        def reported(a: int, b: int) -> bool:
            if b - a < LEAST_CHARS:
                return False
            before = bisect_left(known_starts, b)  # spans that start before the candidate ends
            if (before and reach[before - 1] > a) or self.added(text, a, b) < NOVELTY * (b - a):
                return False
            out.append((a, 3, b))
            return True
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            i, j = bisect_right(ends, a), bisect_left(starts, b)  # words before it, and the first after it
            inside = i < j
            whole = ((last is not None and follows(text, last, a)) or (i > 0 and a - ends[i - 1] <= AROUND)
                     or (not inside and j < len(starts) and starts[j] - b <= AROUND))
            found = whole and reported(a, b)
            if not found and inside:  # a word within the string: what stands before and after it
                found = reported(a, starts[i])
                found = reported(ends[i], b) or found
            if found:
                last = out[-1][2]
        return out


def follows(text: str, last: int, start: int) -> bool:
    """Whether nothing but blanks and quotes lies between; looks back as far as these go."""
    while start > last and text[start - 1] in BETWEEN:
        start -= 1
    return start <= last


def join_spans(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def identifier_dictionary(docs: DataFrame, text_col: str = "text", bound: int = IDENTIFIERS) -> bytes:
    """Frequent identifiers of the whole corpus, the commonest last, where the compressor finds them cheapest."""
    texts = id_text(docs.selectExpr("CAST(NULL AS BIGINT) doc_id", f"`{text_col}` text"))
    counts = stage(term_counts(texts, lambda: (str.split, IDENTIFIER)))
    words = [w for w, _ in frequent_terms(counts, bound)]
    return " ".join(reversed(words)).encode()


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: bytes | None = None) -> DataFrame:
    """One row a document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel``.

    Spans are code points, end exclusive, by start and then kind; whole texts are scanned.
    Time grows with the text's length.  Null text counts as empty: no spans, the digest of
    the empty string.  A null doc_id stays null, repeated rows each give a row, an empty table
    gives no rows, further columns are not looked at.
    """
    primed = docs.sparkSession.sparkContext.broadcast(
        identifier_dictionary(docs, text_col) if identifiers is None else identifiers)

    def make():
        novelty = Novelty(primed.value)

        def run(ids, texts):
            out = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")}
            for t in texts:
                base = base_spans(t)
                new = novelty.spans(t, base)
                kinds = [k for _, k, _ in base]
                for i, c in enumerate(("n_assign", "n_access", "n_hex")):
                    out[c].append(kinds.count(i))
                out["base_sha256"].append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                out["spans"].append(join_spans(base + new))
                out["n_novel"].append(len(new))
            return {"doc_id": ids} | out
        return run
    return map_texts(id_text(docs, id_col, text_col), make, "doc_id long, n_assign long, n_access long, n_hex long, "
                     "base_sha256 string, spans string, n_novel long")


def op4_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))
