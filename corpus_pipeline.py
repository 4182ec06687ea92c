"""Corpus cleaning pipeline: five stages over ``documents``, each of which writes its table.

``STAGES`` holds ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns the rows it keeps with the columns of ``documents`` (the last one: the encoded
documents).  Every stage works on all that its predecessor kept.  A stage finds the ids to
drop first and removes them with one anti-join, so texts are not shuffled; when the ids are
too many to broadcast, they are hashed against the texts instead.

Null doc_ids cannot be addressed: such rows pass the stages that drop by id, except that
exact copies among them are dropped with their texts' group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm import bpe_lexicon, decontaminate, exact_dedup, simhash, toxicity
from ticketlake.llm.common import benchmark, documents, labels, small_side, stage


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``dropped (doc_id)``, columns as they were."""
    ids = stage(dropped.select(F.col("doc_id").alias("_dropped")).where(F.col("_dropped").isNotNull()).distinct())
    return docs.join(small_side(ids), docs["doc_id"] == ids["_dropped"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier chain predicts to be toxic; the chain learns from the labelled rows.

    Null and empty texts get the intercepts' probabilities; without any label nothing is dropped;
    rows with a null doc_id stay; an empty table stays empty.
    """
    return without(docs, toxicity.toxicity(docs, labels(spark, sf_dir)).where("predicted = 1"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that repeat it, one."""
    marked = exact_dedup.exact_duplicates(docs)
    out = without(docs, marked.where(~F.col("kept")))
    again = stage(marked.where("kept AND group_size > 1").groupBy(F.col("doc_id").alias("_again"), "text_sha256")
                  .agg(F.count("*").alias("_rows")).where("_rows > 1").select("_again").distinct())
    n = again.count()
    if not n:  # no id is repeated: nothing to take apart
        return out
    side = small_side(again, n)
    same = out["doc_id"].eqNullSafe(again["_again"])
    once = out.join(side, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(side, same, "left_anti").unionByName(once)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest doc_id stays."""
    return without(docs, simhash.simhash_groups(docs).where("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return without(docs, decontaminate.contaminated(docs, benchmark(spark, sf_dir)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as ``doc_id, n_tokens, ids``.

    Null and empty texts have no token, a null doc_id stays null, repeated rows each give a row, an
    empty table gives no rows; texts of any length are encoded whole.
    """
    import public_tokenizers
    out = bpe_lexicon.bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe_encode", encode),
]

# Classifier, trie join and edit matching are not SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again."""
    docs = documents(spark, sf_dir)
    for _, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
QUERY_SQL = {"pipeline": ORACLE_SQL}
