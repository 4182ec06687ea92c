"""Features, splits and training-side operators.

Scoring and weighting are DataFrame aggregations over long-format
``(id, term, weight)`` tables; model fitting uses ``pyspark.ml``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.functions.text import tokenize
from ticketlake.operators import term_blocks as tb

# ---- hashing and ranks -----------------------------------------------------------------

MIX_MUL = 1103515245
MIX_MOD = 2147483647
BUCKET_ROWS = 100_000


def mix(id_col: Column, seed: int) -> Column:
    """Portable pseudo-random order key of an integer id (same value in any SQL engine)."""
    return F.pmod(F.pmod(id_col.cast("long"), F.lit(MIX_MOD)) * MIX_MUL + seed * 97, F.lit(MIX_MOD))


def sql_mix(expr: str, seed: int) -> str:
    """``mix`` as SQL."""
    return f"(((({expr}) % {MIX_MOD} + {MIX_MOD}) % {MIX_MOD}) * {MIX_MUL} + {seed * 97}) % {MIX_MOD}"


def bucketed_rank(df: DataFrame, part: str, order_key: str, id_col: str, buckets: int | None = None) -> DataFrame:
    """0-based rank within ``part`` by ``(order_key, id)``; ``order_key`` as ``mix`` gives it.

    A label can hold a third of all rows, so a window over the label alone would
    put that third into one task.  Rows are first spread over ``buckets``
    ranges of the key, as many as the rows ask for; a small window over the per-bucket counts
    gives each bucket's offset, and the row rank is computed inside ``(label, bucket)`` only.
    """
    buckets = buckets or max(64, df.count() // BUCKET_ROWS)
    b = df.withColumn("_b", F.floor(F.col(order_key) / (MIX_MOD // buckets + 1)))
    counts = b.groupBy(part, "_b").agg(F.count("*").alias("_n"))
    wo = Window.partitionBy(part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0))).drop("_n")
    wl = Window.partitionBy(part, "_b").orderBy(order_key, id_col)
    local = b.withColumn("_r", F.row_number().over(wl) - 1)
    return (local.join(offsets, [part, "_b"])
            .withColumn("rank", (F.col("_off") + F.col("_r")).cast("long")).drop("_b", "_off", "_r"))


def stratified_split(df: DataFrame, label_col: str, id_col: str, seed: int = 42,
                     fractions: tuple[float, float] = (0.6, 0.2), buckets: int | None = None) -> DataFrame:
    """F8: exact per-label shares: the first ``floor(n*0.6)`` rows of each label (in
    seeded hash order) train, the next up to ``floor(n*0.8)`` validate, the rest test."""
    h = df.withColumn("_h", mix(F.col(id_col), seed))
    r = bucketed_rank(h, label_col, "_h", id_col, buckets)
    n = df.groupBy(label_col).agg(F.count("*").alias("_n"))
    j = r.join(n, label_col)
    c1 = F.floor(F.col("_n") * fractions[0])
    c2 = F.floor(F.col("_n") * (fractions[0] + fractions[1]))
    split = F.when(F.col("rank") < c1, "train").when(F.col("rank") < c2, "val").otherwise("test")
    return j.withColumn("split", split).drop("_h", "_n", "rank")


def stratified_kfold(df: DataFrame, label_col: str, id_col: str, k: int = 5, seed: int = 42,
                     buckets: int | None = None) -> DataFrame:
    """fold = rank within the label (seeded order) modulo k."""
    h = df.withColumn("_h", mix(F.col(id_col), seed))
    r = bucketed_rank(h, label_col, "_h", id_col, buckets)
    return r.withColumn("fold", (F.col("rank") % k).cast("int")).drop("_h", "rank")


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """balanced weights ``n / (k * n_c)`` per row."""
    counts = df.groupBy(label_col).agg(F.count("*").alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count("*").alias("_k"))
    from ticketlake.operators.retrieval import attach_scalars
    w = attach_scalars(counts, tot).select(label_col, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("weight"))
    return df.join(w, label_col)


# ---- TF-IDF ---------------------------------------------------------------------------------

def word_terms(text: Column, ngram: tuple[int, int] = (1, 2)) -> Column:
    """Word n-grams of tokens with at least two word characters."""
    low, high = ngram

    def grams(toks):
        def runs(n):
            starts = F.sequence(F.lit(1), F.size(toks) - n + 1)
            return F.when(F.size(toks) >= n, F.transform(starts, lambda i: F.array_join(F.slice(toks, i, n), " "))
                          ).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.array(*[toks if n == 1 else runs(n) for n in range(low, high + 1)]))
    # a lambda over a list of one keeps the text from being cut again for each gram
    return F.flatten(F.transform(F.array(F.filter(tokenize(text), lambda t: F.length(t) >= 2)), grams))


def char_terms(text: Column, ngram: tuple[int, int] = (3, 5)) -> Column:
    """Character n-grams of the lower-cased text, put together from its single characters, so that
    time grows with the text's length."""
    chars = F.regexp_extract_all(F.lower(text), F.lit(r"([\s\S])"), 1)
    low, high = ngram

    def grams(c):
        return F.flatten(F.array(*[F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), _joined(c, n)))
                                   .otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]))
    # a lambda over a list of one keeps the characters from being taken apart again for each gram
    return F.flatten(F.transform(F.array(chars), grams))


def _joined(c: Column, n: int):
    return lambda i: F.concat(*[F.element_at(c, i + k) for k in range(n)])


def term_tf(df: DataFrame, id_col: str, terms: Column | tb.Grams) -> DataFrame:
    """``(id, term, tf)``: each row's terms counted inside the row, without a shuffle.
    Rows that share an id are separate documents."""
    return tb.term_counts(df, id_col, terms)


def vocabulary(tf: DataFrame, n_docs: DataFrame, min_df: int = 1, max_df: float = 1.0,
               max_features: int | None = None) -> DataFrame:
    """``(term, df, idf)`` with ``idf = ln((1+n)/(1+df)) + 1``: terms within the bounds on their document
    share and, if asked for, the ``max_features`` most frequent in the corpus (ties: smaller term).
    ``tf`` is long format, or ``(term, df, cf)`` as ``document_counts`` gives it.

    The first terms of every partition are the candidates of the exact merge, so no task sorts them all.
    """
    from ticketlake.operators.retrieval import attach_scalars
    stats = tf if "cf" in tf.columns else tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    stats = attach_scalars(stats, n_docs).where((F.col("df") >= min_df) & (F.col("df") <= F.col("n_docs") * max_df))
    if max_features is not None:
        stats = stats.orderBy(F.col("cf").desc(), F.col("term")).limit(max_features)
    return stats.select("term", "df", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


# Terms of a vocabulary that goes to every task.
BROADCAST_TERMS = 1_000_000
HOT = 100  # without effect: terms meet once a block, so that no frequent one needs a way of its own


class Pruned(NamedTuple):
    """A block of TF-IDF features over a pruned vocabulary, to stand beside others."""
    df: DataFrame
    id_col: str
    terms: Column | tb.Grams
    namespace: str
    vocabulary: DataFrame


def _known(df: DataFrame, terms: Column | tb.Grams, min_df: int, max_df: float, max_features: int, n_docs: int) -> DataFrame:
    from ticketlake.session import cut_lineage
    n = df.sparkSession.range(1).select(F.lit(n_docs).cast("long").alias("n_docs"))
    return cut_lineage(vocabulary(tb.document_counts(df, terms), n, min_df, max_df, max_features))


def tfidf_vectors(df: DataFrame, id_col: str, terms: Column | tb.Grams, sublinear: bool = False, min_df: int = 1, max_df: float = 1.0,
                  max_features: int | None = None, namespace: str | None = None, places: int | None = None) -> DataFrame:
    """smoothed TF-IDF ``tf * idf`` (sublinear: ``(1 + ln tf) * idf``), rows L2-normalised.

    ``(id, terms, weights)``: one sparse vector a row that has terms, terms ascending; weights rounded to ``places``.
    A pruned vocabulary goes to the tasks that read the texts; one of any size meets the texts block by block.
    """
    n_docs = df.count()
    if max_features is None:
        return tb.all_vectors(df, id_col, terms, n_docs, sublinear, min_df, max_df, places, namespace)
    known = _known(df, terms, min_df, max_df, max_features, n_docs)
    if max_features > BROADCAST_TERMS:
        return tb.all_vectors(df, id_col, terms, n_docs, sublinear, min_df, max_df, places, namespace, only=known)
    return tb.known_vectors(df, id_col, [terms], [known], sublinear, places, [namespace])


def tfidf(df: DataFrame, id_col: str, terms: Column | tb.Grams, sublinear: bool = False, min_df: int = 1,
          max_df: float = 1.0, max_features: int | None = None, namespace: str | None = None) -> DataFrame:
    """``tfidf_vectors`` in long format ``(id, term, weight)``."""
    vectors = tfidf_vectors(df, id_col, terms, sublinear, min_df, max_df, max_features, namespace)
    return vectors.select("id", F.explode(F.arrays_zip("terms", "weights")).alias("c")).select(
        "id", F.col("c.terms").alias("term"), F.col("c.weights").alias("weight"))


def tfidf_sums(df: DataFrame, id_col: str, label_col: str, terms: Column | tb.Grams) -> DataFrame:
    """``(label_col, term, weight)``: the weights of ``tfidf``, those of a block's rows with one label summed already."""
    return tb.all_vectors(df, id_col, terms, df.count(), False, sum_by=label_col)


def pruned(df: DataFrame, id_col: str, terms: Column | tb.Grams, namespace: str, min_df: int, max_df: float, max_features: int) -> Pruned:
    """F4's vocabulary of one block, fitted."""
    return Pruned(df, id_col, terms, namespace, _known(df, terms, min_df, max_df, max_features, df.count()))


def tfidf_union(word: DataFrame | Pruned, char: DataFrame | Pruned, sublinear: bool = True, places: int | None = None) -> DataFrame:
    """feature union: both blocks side by side (namespaced terms).  Blocks over pruned vocabularies of one
    table become vectors in one pass over it; others are long format."""
    if isinstance(word, Pruned):
        return tb.known_vectors(word.df, word.id_col, [word.terms, char.terms], [word.vocabulary, char.vocabulary], sublinear, places,
                                [word.namespace, char.namespace])
    return word.unionByName(char)


def sparse_vectors(weights: DataFrame) -> DataFrame:
    """``(id, terms, weights)``: one sparse vector an id, terms ascending (as many as its text has)."""
    listed = weights.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("_v"))
    return listed.select("id", F.transform("_v", lambda v: v["term"]).alias("terms"),
                         F.transform("_v", lambda v: v["weight"]).alias("weights"))


# ---- F10 / F15: arrays ---------------------------------------------------------------------

def softmax(logits: Column) -> Column:
    """Max-shifted softmax of an array column."""
    m = F.array_max(logits)
    ex = F.transform(logits, lambda x: F.exp(x - m))
    s = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    return F.transform(ex, lambda x: x / s)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def argmax_label(probs: Column, labels: list[str]) -> tuple[Column, Column]:
    """label of the first maximum, and that maximum as the confidence."""
    m = F.array_max(probs)
    pos = F.array_position(probs, m)
    return F.element_at(F.array(*[F.lit(x) for x in labels]), pos.cast("int")), m
