"""Training-corpus preparation (D1, D4, D5): dedupe and ordered rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------
# The vague-simplification patterns (in order) and the casual
# contraction / shorthand pairs (in order).
# ---------------------------------------------------------------------------------
VAGUE_SUBS = [
    (r"\$[\d,]+\.?\d*", "some money"),
    (r"\b\d+ days?\b", "a while"),
    (r"\b\d+ months?\b", "a few months"),
    (r"Error [\p{L}\p{N}_]+[:\s][^\.\,]+", "an error"),
    (r"[A-Z_]{6,}", "an error"),
    (r"\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}",
     "recently"),
]
CASUAL_SUBS = [
    ("I am ", "I'm "), ("I have ", "I've "), ("I would ", "I'd "), ("I will ", "I'll "),
    ("cannot ", "can't "), ("do not ", "don't "), ("does not ", "doesn't "), ("did not ", "didn't "),
    ("will not ", "won't "), ("is not ", "isn't "), ("are not ", "aren't "), ("have not ", "haven't "),
    ("has not ", "hasn't "), ("should not ", "shouldn't "), ("would not ", "wouldn't "),
    ("could not ", "couldn't "), ("it is ", "it's "), ("that is ", "that's "), ("there is ", "there's "),
    ("we are ", "we're "), ("they are ", "they're "), ("you are ", "you're "), ("Please ", "pls "),
    ("immediately", "asap"), ("as soon as possible", "asap"),
]


def dedupe_within_category(df: DataFrame, category_col: str, text_col: str, id_col: str) -> DataFrame:
    """One row per (category, text), the first id kept; a partial aggregate, so
    a text copied a million times is combined map-side, never ranked in one task."""
    key = F.sha2(F.col(text_col), 256).alias("_text")  # 256 bits stand for the text in the shuffle
    return df.groupBy(category_col, key).agg(F.min(id_col).alias(id_col), F.count("*").alias("n_copies")).select(
        category_col, id_col, "n_copies")


def generalize_specifics(text: Column) -> Column:
    """Money, durations, error codes and dates become vague words, in order."""
    out = text
    for pat, rep in VAGUE_SUBS:
        out = F.regexp_replace(out, pat, rep)
    return out


def casual_rewrite(text: Column, gates: list[Column] | None = None) -> Column:
    """Ordered literal rewrites; ``gates`` (one boolean column per pair, e.g. a
    hash draw) switch individual pairs off."""
    out = text
    for i, (a, b) in enumerate(CASUAL_SUBS):
        rewritten = F.replace(out, F.lit(a), F.lit(b))
        out = rewritten if gates is None else F.when(gates[i], rewritten).otherwise(out)
    return out
