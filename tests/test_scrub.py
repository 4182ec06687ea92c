"""Entities and lemmas from tables, and the streaming scrub, against their small forms."""

from __future__ import annotations

import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from ticketlake.operators import scrub as sc
from ticketlake.session import checkpoint_dir
from ticketlake.sources import tables as tb
from ticketlake.streaming import streams as st

NAMES = {"PERSON": ["Ann", "Ann Lee", "O'Neil", "Lee Ann Marsh"], "ORG": ["Lee", "Acme Co.", "Ünal AG", "Ann"],
         "GPE": ["Bad Ems", "Ems"], "LOC": ["Bad", "the Bad Ems"]}
TEXTS = ["Ann Lee met Ann  \n Lee and Ann.", "O'Neil's Lee Ann Marsh Ann", "xAnn Ann_ Ann-Lee (Ann)", "Acme Co. and Acme Co", None, "",
         "Ünal AG ÜnalAG Ünal  AG", "Bad Ems, the Bad Ems; Ems Bad", "Lee Ann Marshall", "Ann" * 3 + " Ann", "  Ann\t\tLee  "]


def texts(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "id long, t string, _found string")


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_table_of_names_equals_the_pattern(spark, monkeypatch, bound):
    monkeypatch.setattr(sc, "BROADCAST_NAMES", bound)
    rng = random.Random(4)
    words = ["Ann", "Lee", "Marsh", "O'Neil", "Acme", "Co.", "Co", "Ünal", "AG", "Bad", "Ems", "the", ",", ".", "\n", "and"]
    rows = TEXTS + ["".join(w + rng.choice([" ", " ", "", "  "]) for w in rng.choices(words, k=30)) for _ in range(20)]
    df = texts(spark, rows)
    want = df.select("id", sc.redact_entities(F.col("t"), NAMES).alias("t"))
    got = sc.redact_entities_table(df, "t", sc.gazetteer_table(spark, NAMES))
    assert got.columns == df.columns
    assert sorted(map(tuple, got.select("id", "t").collect())) == sorted(map(tuple, want.collect()))


def test_hits_rows_without_key_and_no_names(spark):
    df = spark.createDataFrame([("Ann",), ("Ann",), ("none",), (None,)], "t string")
    out = sc.redact_entities_table(df, "t", sc.gazetteer_table(spark, NAMES), "hits")
    assert sorted((r.t or "", r.hits) for r in out.collect()) == [("", 0), ("[REDACTED_PERSON]", 1), ("[REDACTED_PERSON]", 1), ("none", 0)]
    none = sc.redact_entities_table(df, "t", spark.createDataFrame([], "label string, name string"), "hits")
    assert sorted((r.t or "", r.hits) for r in none.collect()) == [("", 0), ("Ann", 0), ("Ann", 0), ("none", 0)]


def test_stats_count_as_the_redaction_does(spark):
    df = texts(spark).select("id", "t")
    stats = sc.scrub_stats(df, ["t"], masks={}, gazetteer=NAMES).first()
    hits = sc.redact_entities_table(df, "t", sc.gazetteer_table(spark, NAMES), "n").agg(F.sum("n")).first()[0]
    assert stats.ner_matches == hits and hits > 10


def test_only_runs_that_begin_like_a_name_are_looked_up(spark):
    """Long texts without a name leave nothing to join; before, each unit was a row for each length of a name."""
    units = spark.createDataFrame([(1, ["a", " ", "b", " ", "Ann", " \n", "Lee", "."]), (2, []), (3, ["Ann"])], "_row long, u array<string>")
    got = sc._candidates(units, [1, 3], {"Ann": [1, 3]}).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 4, 1, "Ann", " ", "Ann", "Ann", " "), (1, 4, 3, "Ann Lee", " ", "Ann", "Lee", "."),
                                                       (3, 0, 1, "Ann", None, "Ann", "Ann", None)], key=str)
    assert sc._candidates(units, [1, 3], None).count() == 8 + 6 + 1
    began = time.time()
    words = spark.range(4000).select("id", F.repeat(F.lit("some words, and more "), 300).alias("t"))
    out = sc.redact_entities_table(words, "t", sc.gazetteer_table(spark, NAMES), "hits").agg(F.sum("hits"), F.count("t")).first()
    assert tuple(out) == (0, 4000) and time.time() - began < 60


def test_many_names_in_one_pass(spark):
    """200,000 names of one and two words; the text has 20,000 words."""
    names = spark.range(200_000).select(F.lit("PERSON").alias("label"), F.concat(
        F.lit("N"), F.col("id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit(" M"), F.col("id"))).otherwise("")).alias("name"))
    text = " ".join(f"N{i} M{i}" if i % 2 == 0 else f"N{i}" for i in range(0, 200_000, 15))
    began = time.time()
    out = sc.redact_entities_table(texts(spark, [text, "M2 N2"]), "t", names, "hits").orderBy("id").collect()
    assert out[0].hits == len(range(0, 200_000, 15)) and out[1].hits == 0 and "N" not in out[0].t.replace("PERSON", "")
    assert time.time() - began < 60


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_lemma_table(spark, monkeypatch, bound):
    monkeypatch.setattr(sc, "BROADCAST_NAMES", bound)
    lemmas = spark.createDataFrame([("WAS", "be"), ("is", "be"), ("is", "is"), ("mice", None), (None, "x")], "word string, lemma string")
    df = spark.createDataFrame([(1, " it is  what it was "), (1, "mice"), (2, None), (3, "")], "k long, t string")
    out = sc.lemmatize_join(df, "t", lemmas, "o").collect()
    assert sorted((r.k, r.o) for r in out if r.o is not None) == [(1, "it be what it be"), (1, "mice"), (3, "")]
    assert [r.o for r in out if r.k == 2] == [None]


def test_streaming_scrub_survives_a_restart(spark):
    df = spark.createDataFrame([(i, f"mail a{i}@b.com &amp; Ann {i}") for i in range(40)], "ticket_id long, description string")
    base = f"{checkpoint_dir(spark)}/scrub-test-{uuid.uuid4().hex}"
    df.repartition(3).write.parquet(f"{base}/in")

    def arriving():
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    how = {"text_columns": ["description"], "masks": {}, "gazetteer": NAMES, "age_column": None}
    with pytest.raises(Exception, match="stopped after trigger 1"):
        st.scrub_stream(arriving(), base, max_batches=2, **how)
    out = st.scrub_stream(arriving(), base, **how)
    want = sc.scrub_table(df, **how)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    again = st.scrub_stream(arriving(), base, **how)  # nothing new has come
    assert again.count() == 40


def test_documents_share_files(spark):
    path = f"{checkpoint_dir(spark)}/pack-{uuid.uuid4().hex}"
    rows = [(i, t) for i, t in enumerate(["a\nb\n\nc", "", "x" * 1000, "\n", None, "é\r\n"])]
    tb.write_kb_pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), path)
    out = tb.scan_kb_pack(spark, path)
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text is not None) == [r for r in rows if r[1] is not None]
    assert out.count() == 6 and out.select("source").distinct().count() <= 2
