"""Evaluation and cost aggregates.

All metrics are aggregations: per-query / per-class partial aggregates first,
then small final aggregates.  No metric collects rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.functions.text import tokenize, words
from ticketlake.session import cut_lineage

# Token prices per 1,000 tokens.
INPUT_COST_PER_1K = 0.00025
OUTPUT_COST_PER_1K = 0.00125
ROUND = 9


# ---- E1-E4: retrieval metrics ---------------------------------------------------------

def relevance_join(run: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach ``is_rel`` to a run ``(query_id, rank, chunk_id)``; unlabelled = not relevant."""
    return (run.join(labels.select("query_id", "chunk_id", "is_rel"), ["query_id", "chunk_id"], "left")
            .withColumn("is_rel", F.coalesce(F.col("is_rel"), F.lit(False))))


# Words of a query's beginning by which chunks that may hold it are found.
PIECE_WORDS = 8
# Queries that may be broadcast.
BROADCAST_QUERIES = 1_000_000


def containment_labels(queries: DataFrame, chunks: DataFrame, piece: int = PIECE_WORDS) -> DataFrame:
    """E3's relevance table ``(query_id, chunk_id, is_rel)`` from the texts alone: a chunk is relevant to a
    query whose words it holds in a row.  No run is read, so chunks that were not retrieved count too.

    Every run of ``piece`` words of a chunk is looked up among the queries' beginnings (shorter queries:
    all their words) by an equi-join on its hash; the pairs found are then compared in full.  Queries
    without a word have no relevant chunk.
    """
    q = cut_lineage(queries.select("query_id", tokenize(F.col("text")).alias("w")).where(F.size("w") > 0).select(
        "query_id", F.array_join("w", " ").alias("_query"), F.least(F.size("w"), F.lit(piece)).alias("_size"),
        F.xxhash64(F.array_join(F.slice("w", 1, piece), " ")).alias("_key")))
    sizes = [r[0] for r in q.select("_size").distinct().collect()]  # `piece` numbers at most
    words = chunks.select("chunk_id", tokenize(F.col("text")).alias("w"))

    def runs(n):
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(
            F.array_join(F.slice("w", i, n), " ")))).otherwise(F.array().cast("array<long>"))
    lists = [runs(n) for n in sizes] or [F.array().cast("array<long>")]
    keys = words.select("chunk_id", F.explode(F.array_distinct(F.flatten(F.array(*lists)))).alias("_key"))
    side = F.broadcast(q) if q.count() <= BROADCAST_QUERIES else q
    pairs = keys.join(side, "_key").select("query_id", "chunk_id", "_query").distinct()
    text = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    whole = F.contains(text, F.concat(F.lit(" "), F.col("_query"), F.lit(" ")))
    return pairs.join(words, "chunk_id").where(whole).select("query_id", "chunk_id", F.lit(True).alias("is_rel")).distinct()


def per_query_metrics(rel: DataFrame, k: int = 3, relevant: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank and NDCG of each query's top-k (ranks 0-based).

    NDCG's ideal ranking is the retrieved list itself sorted (the relevant items it contains first), and
    0 when nothing relevant was retrieved.  Given ``relevant (query_id, n_relevant)``, the ideal ranking
    begins with all of a query's relevant items, retrieved or not.
    """
    top = rel.where(F.col("rank") < k)
    g = top.groupBy("query_id").agg(
        F.min(F.when(F.col("is_rel"), F.col("rank"))).alias("first_rel"),
        F.sum(F.when(F.col("is_rel"), F.lit(1.0) / F.log2(F.col("rank") + 2)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("is_rel"), 1).otherwise(0)).alias("n_rel"))
    if relevant is not None:
        g = g.join(relevant.select("query_id", F.least("n_relevant", F.lit(k)).alias("n_best")), "query_id", "left").withColumn(
            "n_rel", F.greatest("n_rel", F.coalesce("n_best", F.lit(0))))
    idcg = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n_rel"), F.lit(1))),
                       F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.log2(i + 1))
    return g.select(
        "query_id",
        F.when(F.col("first_rel").isNull(), F.lit(0.0)).otherwise(F.lit(1.0) / (F.col("first_rel") + 1)).alias("rr"),
        F.when(F.col("n_rel") > 0, F.col("dcg") / idcg).otherwise(F.lit(0.0)).alias("ndcg"))


def retrieval_metrics(rel: DataFrame, k: int = 3, queries: DataFrame | None = None,
                      relevant: DataFrame | None = None) -> DataFrame:
    """E1 + E2: one row ``(mrr_at_3, ndcg_at_3)``; zeros for an empty run.  Given all ``queries
    (query_id)``, those without any hit count as 0; ``relevant`` as in ``per_query_metrics``."""
    pq = per_query_metrics(rel, k, relevant)
    if queries is not None:
        pq = queries.select("query_id").join(pq, "query_id", "left").fillna(0.0, ["rr", "ndcg"])
    return pq.agg(F.round(F.coalesce(F.avg("rr"), F.lit(0.0)), ROUND).alias("mrr_at_3"),
                  F.round(F.coalesce(F.avg("ndcg"), F.lit(0.0)), ROUND).alias("ndcg_at_3"))


def compare_runs(rel_by_run: DataFrame, baseline: str, improved: str, k: int = 3) -> DataFrame:
    """Metrics per run, side by side, delta rounded to 4 places."""
    pq = per_query_metrics(rel_by_run.withColumn("query_id", F.struct("run", "query_id")), k)
    m = (pq.select(F.col("query_id.run").alias("run"), "rr", "ndcg").groupBy("run")
         .agg(F.avg("rr").alias("mrr_at_3"), F.avg("ndcg").alias("ndcg_at_3")))
    long = m.select("run", F.explode(F.array(
        F.struct(F.lit("mrr@3").alias("metric"), F.col("mrr_at_3").alias("v")),
        F.struct(F.lit("ndcg@3").alias("metric"), F.col("ndcg_at_3").alias("v")))).alias("x"))
    wide = (long.groupBy(F.col("x.metric").alias("metric"))
            .pivot("run", [baseline, improved]).agg(F.first("x.v")))
    return wide.select("metric", F.round(F.col(baseline), ROUND).alias("baseline"),
                       F.round(F.col(improved), ROUND).alias("improved"),
                       F.round(F.col(improved) - F.col(baseline), 4).alias("delta"))


# ---- E5-E8: classification and calibration ---------------------------------------------

def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Counts per (truth, pred): a partial aggregate, k^2 rows at most."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """E5: per-class precision / recall / F1 / support plus accuracy, macro and
    weighted rows (undefined ratios count as 0)."""
    cm = confusion(df, truth, pred)
    tp = cm.where(F.col("truth") == F.col("pred")).select(F.col("truth").alias("label"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    predicted = cm.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("n_pred"))
    per = (sup.join(predicted, "label", "full").join(tp, "label", "left")
           .select("label", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("support", F.lit(0)).alias("support"),
                   F.coalesce("n_pred", F.lit(0)).alias("n_pred")))
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.select("label", p.alias("precision"), r.alias("recall"), "support", "tp")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                         .otherwise(F.lit(0.0)))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("correct"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    rows = per.select("label", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    extra = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), (F.col("correct") / F.col("n")).alias("f1"),
                 F.col("n").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("n").cast("long").alias("support")))).alias("x"))
    extra = extra.select("x.*")
    out = rows.unionByName(extra.toDF(*rows.columns))
    return out.select("label", *[F.round(c, ROUND).alias(c) for c in ("precision", "recall", "f1")], "support")


def macro_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row ``(macro_f1, accuracy)``."""
    rep = classification_report(df, truth, pred)
    return rep.agg(F.max(F.when(F.col("label") == "macro avg", F.col("f1"))).alias("macro_f1"),
                   F.max(F.when(F.col("label") == "accuracy", F.col("f1"))).alias("accuracy"))


def calibration_bin(conf: Column, n_bins: int = 10) -> Column:
    """Index of the ``(lo, hi]`` bin with edges ``i * (1 / n_bins)`` (as ``linspace``
    produces them); confidence 0 is in no bin."""
    step = 1.0 / n_bins
    b0 = F.ceil(conf * n_bins).cast("int") - 1
    b = (F.when(conf <= b0 * F.lit(step), b0 - 1).when(conf > (b0 + 1) * F.lit(step), b0 + 1).otherwise(b0))
    return F.when(conf > 0, F.least(b, F.lit(n_bins - 1)))


def reliability_bins(df: DataFrame, conf_col: str, correct_col: str, n_bins: int = 10) -> DataFrame:
    """Per bin: count, mean confidence, accuracy, share of all rows."""
    total = df.agg(F.count("*").alias("n_all"))
    b = df.select(calibration_bin(F.col(conf_col), n_bins).alias("bin"), F.col(conf_col).alias("c"),
                  F.col(correct_col).cast("double").alias("ok"))
    g = b.where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("c").alias("mean_conf"), F.avg("ok").alias("accuracy"))
    from ticketlake.operators.retrieval import attach_scalars
    return attach_scalars(g, total).select(
        F.col("bin").cast("int").alias("bin"), F.col("n").cast("long").alias("n"),
        F.round("mean_conf", ROUND).alias("mean_conf"), F.round("accuracy", ROUND).alias("accuracy"),
        F.round(F.col("n") / F.col("n_all"), ROUND).alias("share"))


def ece(df: DataFrame, conf_col: str, correct_col: str, n_bins: int = 10) -> DataFrame:
    """Sum over bins of |accuracy - mean confidence| x share."""
    total = df.agg(F.count("*").alias("n_all"))
    b = df.select(calibration_bin(F.col(conf_col), n_bins).alias("bin"), F.col(conf_col).alias("c"),
                  F.col(correct_col).cast("double").alias("ok"))
    g = b.where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("c").alias("mc"), F.avg("ok").alias("acc"))
    from ticketlake.operators.retrieval import attach_scalars
    g = attach_scalars(g, total)
    return g.agg(F.round(F.coalesce(F.sum(F.abs(F.col("acc") - F.col("mc")) * F.col("n") / F.col("n_all")),
                                    F.lit(0.0)), ROUND).alias("ece"))


# ---- E9-E10: answer evaluation ------------------------------------------------------------

def first_ranked(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` first rows of each key by ``(rank, text)``, cut down before they are shuffled."""
    w = Window.partitionBy(key).orderBy("rank", "text")
    return rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")


def answer_eval_set(answers: DataFrame, contexts: DataFrame, key: str = "ticket_id", k: int | None = 3) -> DataFrame:
    """Non-abstained, non-blank answers with the texts of their ``k`` first contexts (None: of all)."""
    ok = answers.where(~F.col("abstain_flag") & (F.trim(F.coalesce("draft_response", F.lit(""))) != ""))
    listed = contexts if k is None else first_ranked(contexts, key, k)
    ctx = listed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_c"))
    return ok.join(ctx, key, "left").select(
        key, F.col("draft_response").alias("answer"),
        F.coalesce(F.transform("_c", lambda s: s["text"]), F.array().cast("array<string>")).alias("contexts"))


def answer_eval_summary(answers: DataFrame, metrics: DataFrame, metric_cols: list[str],
                        key: str = "ticket_id") -> DataFrame:
    """Means of the per-answer metrics over evaluated answers, plus evaluated /
    abstained counts; zeros when nothing was evaluated."""
    counts = answers.agg(
        F.count_if(~F.col("abstain_flag") & (F.trim(F.coalesce("draft_response", F.lit(""))) != ""))
        .cast("long").alias("n_evaluated"),
        F.count_if(F.col("abstain_flag")).cast("long").alias("n_abstained"))
    evald = answers.where(~F.col("abstain_flag") & (F.trim(F.coalesce("draft_response", F.lit(""))) != ""))
    means = evald.select(key).join(metrics, key).agg(
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), ROUND).alias(c) for c in metric_cols])
    from ticketlake.operators.retrieval import attach_scalars
    return attach_scalars(counts, means)


# ---- E11-E15: cost ----------------------------------------------------------------------

def usage_cost(usage: DataFrame) -> DataFrame:
    """Per usage record, tokens/1000 x price, input plus output."""
    cost = (F.col("input_tokens").cast("double") / 1000.0 * INPUT_COST_PER_1K
            + F.col("output_tokens").cast("double") / 1000.0 * OUTPUT_COST_PER_1K)
    return usage.withColumn("cost_usd", cost)


def _cost_aggs():
    return [F.sum("input_tokens").cast("long").alias("total_input_tokens"),
            F.sum("output_tokens").cast("long").alias("total_output_tokens"),
            F.round(F.sum("cost_usd"), 12).alias("total_cost_usd"),
            F.count("*").cast("long").alias("call_count")]


def cost_by_component(usage: DataFrame) -> DataFrame:
    """E12."""
    return usage_cost(usage).groupBy("component").agg(*_cost_aggs())


def cost_totals(usage: DataFrame) -> DataFrame:
    """One row; zeros for an empty log."""
    t = usage_cost(usage).agg(*_cost_aggs())
    return t.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in
                      ("total_input_tokens", "total_output_tokens", "total_cost_usd")],
                    F.col("call_count").alias("total_calls"))


def cost_by_ticket(usage: DataFrame) -> DataFrame:
    """Records without a ticket id are skipped."""
    return usage_cost(usage).where(F.col("ticket_id").isNotNull()).groupBy("ticket_id").agg(*_cost_aggs())


def avg_cost_per_call(usage: DataFrame) -> DataFrame:
    """Total cost / max(calls, 1) (what the reference calls per-ticket cost),
    and the true mean over tickets."""
    c = usage_cost(usage)
    per_call = c.agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1)), 15)
                     .alias("avg_cost_per_call"))
    per_ticket = (c.where(F.col("ticket_id").isNotNull()).groupBy("ticket_id").agg(F.sum("cost_usd").alias("t"))
                  .agg(F.round(F.coalesce(F.avg("t"), F.lit(0.0)), 15).alias("avg_cost_per_ticket")))
    from ticketlake.operators.retrieval import attach_scalars
    return attach_scalars(per_call, per_ticket)


# ---- E16-E17: corpus ---------------------------------------------------------------------

def label_distribution(df: DataFrame, label_col: str, split_col: str | None = None) -> DataFrame:
    """Counts per (split, label) and their share of the split, rounded half-up
    to 3 places with exact integer arithmetic."""
    keys = [split_col] if split_col else []
    g = df.groupBy(*keys, label_col).agg(F.count("*").alias("n"))
    tot = df.groupBy(*keys).agg(F.count("*").alias("total")) if keys else df.agg(F.count("*").alias("total"))
    from ticketlake.operators.retrieval import attach_scalars
    j = g.join(tot, keys) if keys else attach_scalars(g, tot)
    share = F.expr("div(n * 2000 + total, 2 * total)") / F.lit(1000.0)
    return j.select(*keys, label_col, F.col("n").cast("long").alias("n"), share.alias("share"))


def corpus_quality(df: DataFrame, text_col: str, approx: bool = False) -> DataFrame:
    """Rows, unique texts, duplicate %, mean words, texts under 10 words."""
    nw = F.size(words(F.col(text_col)))
    uniq = F.approx_count_distinct(text_col) if approx else F.count_distinct(F.sha2(text_col, 256))
    return df.agg(F.count("*").cast("long").alias("n"), uniq.cast("long").alias("n_unique"),
                  F.round(F.avg(nw), ROUND).alias("avg_words"),
                  F.count_if(nw < 10).cast("long").alias("n_short")).select(
        "n", "n_unique", F.round((F.col("n") - F.col("n_unique")) / F.col("n") * 100, ROUND).alias("dupe_pct"),
        "avg_words", "n_short")


def cost_report(usage: DataFrame) -> DataFrame:
    """``(section, key, total_cost_usd, call_count)``: the total, each component and each ticket."""
    c = usage_cost(usage)
    sums = [F.round(F.sum("cost_usd"), ROUND).alias("total_cost_usd"), F.count("*").cast("long").alias("call_count")]

    def part(section, rows, key):
        g = rows.groupBy(key.alias("key")) if key is not None else rows.groupBy(F.lit("").alias("key"))
        return g.agg(*sums).select(F.lit(section).alias("section"), "key", "total_cost_usd", "call_count")
    return (part("total", c, None).unionByName(part("component", c, F.col("component")))
            .unionByName(part("ticket", c.where(F.col("ticket_id").isNotNull()), F.col("ticket_id").cast("string"))))


def write_cost_report(usage: DataFrame, path: str) -> None:
    """S7 sink: the report as JSON lines."""
    cost_report(usage).write.mode("overwrite").json(path)
