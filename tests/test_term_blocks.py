"""Block-wise TF-IDF: no shuffle of rows' terms, alphabets of any size, several blocks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.test_features import TEXTS, plain
from ticketlake.operators import features as fe
from ticketlake.operators import rules as rl
from ticketlake.operators import term_blocks as tb

WIDE = ["".join(chr(0x4E00 + (i * 7) % 20_000) for i in range(20_000)), "".join(chr(0x4E00 + (i * 7) % 20_000) for i in range(9_000, 9_900)) + "abcabc"]


def flat(vectors):
    return {(r.id, t): round(w, 9) for r in vectors.collect() for t, w in zip(r.terms, r.weights, strict=True)}


@pytest.mark.parametrize("kind,texts,sub,min_df,top", [
    ("word", TEXTS, False, 1, None), ("char", TEXTS, True, 1, None), ("char", TEXTS, True, 2, 30), ("word", TEXTS, True, 1, 5),
    ("char", WIDE, True, 1, None), ("char", WIDE, False, 2, 800)])
def test_vectors_equal_the_formula(spark, kind, texts, sub, min_df, top):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    grams = (tb.word_grams if kind == "word" else tb.char_grams)(F.col("t"))
    out = fe.tfidf_vectors(df, "k", grams, sub, min_df, 1.0, top)
    assert all(r.terms == sorted(r.terms, key=str.encode) for r in out.collect())
    assert flat(out) == plain(texts, kind, sub, min_df, 1.0, top or 10**9)


def test_pruned_vectors_are_made_where_rows_are_read(spark):
    df = spark.range(50).select(F.col("id").alias("k"), F.concat_ws(" ", F.lit("red apple"), F.col("id") % 7).alias("t"))
    for out in (fe.tfidf_vectors(df, "k", tb.char_grams(F.col("t")), True, 2, 0.95, 20),
                fe.tfidf_union(fe.pruned(df, "k", tb.word_grams(F.col("t")), "word", 1, 1.0, 9), fe.pruned(df, "k", tb.char_grams(F.col("t")), "char", 1, 1.0, 9))):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_union_puts_the_blocks_side_by_side(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, t string")
    word, char = (fe.pruned(df, "k", g(F.col("t")), n, 1, 1.0, 25) for g, n in ((tb.word_grams, "word"), (tb.char_grams, "char")))
    want = {(i, f"{n}:{g}"): w for n in ("word", "char") for (i, g), w in plain(TEXTS, n, True, 1, 1.0, 25).items()}
    assert flat(fe.tfidf_union(word, char)) == want


def test_sums_by_label(spark):
    rows = [(i, t, "x" if i % 2 else None) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "k long, t string, c string").repartition(3)
    got = {(r.c, r.term): r.w for r in fe.tfidf_sums(df, "k", "c", tb.word_grams(F.col("t"))).groupBy("c", "term").agg(F.round(F.sum("weight"), 6).alias("w")).collect()}
    want = {}
    for (i, g), w in plain(TEXTS, "word", False, 1, 1.0, 10**9).items():
        want[rows[i][2], g] = want.get((rows[i][2], g), 0) + w
    assert got == {k: round(w, 6) for k, w in want.items()}


def test_a_block_sends_and_stores_packed_values_only(spark):
    """Blocks were rows of long arrays of strings, too large for a reader's memory."""
    df = spark.range(64).select(F.col("id").alias("k"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(
        F.lit("w"), F.hash(i, "id").cast("string").substr(-6, 6)))).alias("t"))
    grams = tb.word_grams(F.col("t"))
    blocks = tb.stored_blocks(df, "k", grams)
    assert blocks.dtypes == [("ids", "array<bigint>"), ("block", "bigint"), ("units", "bigint"), ("value", "binary")]
    assert blocks.agg(F.max(F.length("value") / F.col("units"))).first()[0] < 12
    plan = fe.tfidf_vectors(df, "k", grams)._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "Exchange" in line]
    assert sent and "term" not in " ".join(sent)


def test_numbers_and_bytes_are_opened_as_they_were_shut():
    import numpy as np
    parts = [np.array([0, 1, -5, 2**31 - 1]), np.zeros(0, np.int64), np.frombuffer(b"a b", np.uint8)]
    assert [a.tolist() for a in tb._opened(tb._shut(*parts))] == [p.tolist() for p in parts]


def test_vectors_over_a_table_of_terms(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, t string")
    for kind, grams in (("word", tb.word_grams(F.col("t"))), ("char", tb.char_grams(F.col("t")))):
        known = fe._known(df, grams, 1, 1.0, 25, len(TEXTS))
        assert flat(tb.all_vectors(df, "k", grams, len(TEXTS), True, only=known)) == plain(TEXTS, kind, True, 1, 1.0, 25)


@pytest.mark.parametrize("share", [0.005, 0.9, 5.0])
def test_keywords_of_texts_are_those_of_all_terms(spark, share):
    """Terms that few rows of a class hold are left out of the sums only if they cannot be keywords."""
    texts = ["red apple", "red pear pear", "blue car", "blue bus bus", "red car", "", "green", "green red tram", None]
    rows = list(zip(range(len(texts)), texts, ["f", "f", "v", "v", "v", "none", "g", "g", None], strict=True))
    df = spark.createDataFrame(rows, "k long, t string, c string")
    want = rl.class_keywords(fe.tfidf(df, "k", fe.word_terms(F.col("t"))), df.select(F.col("k").alias("id"), "c"), "id", "c", 3)
    got = rl.text_keywords(df, "c", tb.word_grams(F.col("t")), 3, share)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_table_s_terms_are_dealt_by_its_size_and_not_sent_as_rows(spark, tmp_path):
    """every term of every block was a row of the shuffle."""
    df = spark.range(300).select(F.concat_ws(" ", F.lit("red"), F.col("id")).alias("t"))
    plan = tb.document_counts(df, tb.word_grams(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(term" not in plan
    df.write.parquet(f"{tmp_path}/t")
    assert tb._buckets(spark.read.parquet(f"{tmp_path}/t")) == 8
    assert tb._buckets(spark.sparkContext.parallelize([("a",)]).toDF("t string")) == 256


def test_the_rules_query_mines_its_keywords_from_packed_blocks(spark, monkeypatch):
    """its keywords came from rows of all terms."""
    from ticketlake.plans import q_features as qf
    asked, whole = [], tb.all_vectors
    monkeypatch.setattr(tb, "all_vectors", lambda *a, **k: asked.append(k["flags"]) or whole(*a, **k))
    assert qf._keywords(spark, "/root/testdata/sf0.001").count() == 10 * len(asked[0].rows)
    assert asked[0].shares.keys() == asked[0].rows.keys()
