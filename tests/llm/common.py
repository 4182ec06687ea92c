"""Small tables for the corpus operators."""

from __future__ import annotations

import random

from pyspark.sql import types as T

WORDS = "the of and to a in is rener thonly ertion ander hethe inge onest blenit".split()

# documents plus columns whose names the operators use inside
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       *[T.StructField(c, T.StringType()) for c in ("fp", "block", "ids", "y", "held", "rid", "key", "id", "term")]])


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def edge_rows() -> list[tuple[int | None, str | None]]:
    """Nulls in each column, empty and blank texts, a very long one, copies, near copies, repeated rows."""
    rng = random.Random(5)
    base = prose(rng, 80)
    near = base.replace("rener", "renor", 1)
    return [(1, None), (2, ""), (3, " \t\n"), (4, base), (5, base), (6, near), (7, "one"), (7, "one"), (8, "Two WORDS"),
            (None, base), (None, None), (9, prose(rng, 20_000)), (10, "é漢字🙂 ÀÉ 'll don't"), (11, "x" * 3000),
            (12, prose(rng, 30) + base[50:250] + prose(rng, 10)), (13, base), (14, prose(rng, 60)), (-3, near + " tail"),
            (15, "<|endoftext|>a<|startoftext|>  b<|endo"), (16, "\x1c\x1d a\x1fb \x00")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "a", "b", None, "c", "d", "e", "f", "g", "h") for i, t in rows], SCHEMA)


def docs(spark):
    return frame(spark, edge_rows())


def empty(spark):
    return frame(spark, [])
