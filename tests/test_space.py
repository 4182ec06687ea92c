"""White space as Python takes it, without a pattern that is tried at every character."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlake.functions import text as tx

TEXTS = ["", " ", "a", " a  b ", "\u3000a\u2003\u00a0b\x1c c\x85", "{x} a {y z}\t{ }b{}", "\n\x0b\f\r", "\u200b a\u180e b", "\u00c4 \ud83d\ude00 \u2028z", None]
TEXTS = [t and t.encode("utf-16", "surrogatepass").decode("utf-16") for t in TEXTS]


def test_white_space_is_pythons(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = df.select("i", tx.words(F.col("t")).alias("w"), tx.strip_unicode(F.col("t")).alias("s"), tx.lemmatize(F.col("t")).alias("l"),
                    tx.normalize_ticket_text(F.col("t")).alias("n")).orderBy("i").collect()
    import re
    for r, t in zip(got, TEXTS, strict=True):
        if t is None:
            assert r.w is None and r.s is None and r.n is None
            continue
        assert r.w == t.split() and r.s == t.strip() and r.l == " ".join(t.split())
        assert r.n == " ".join(re.sub(r"\{[^{}]+\}", " ", t.lower()).split())


def test_space_is_found_without_patterns(spark):
    df = spark.createDataFrame([("a",)], "t string")
    for c in (tx.words(F.col("t")), tx.strip_unicode(F.col("t")), tx.lemmatize(F.col("t"))):
        assert "\\x{3000}" not in df.select(c)._jdf.queryExecution().optimizedPlan().toString()
