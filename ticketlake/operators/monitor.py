"""Monitoring aggregates over the prediction log, usage log and feedback.

Each takes a batch or streaming DataFrame with an event-time column ``ts``
(``TimestampType``); the streaming forms add a watermark (see
``ticketlake.streaming``).  Alert thresholds are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.session import cut_lineage

from ticketlake.operators.evaluate import usage_cost

ROUND = 9
# Documented alert thresholds.
TIER3_RATE_MAX = 0.40
CONFIDENCE_DROP_MAX = 0.10
MANUAL_REVIEW_MAX = 0.50
RETRIEVAL_SCORE_MIN = 0.30
ABSTAIN_RATE_MAX = 0.30
CITATIONS_MIN = 0.5
LATENCY_P95_MAX_MS = 10_000.0
ERROR_RATE_MAX = 0.05


def fmt_ts(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def tier3_rate_hourly(log: DataFrame, max_rate: float = TIER3_RATE_MAX) -> DataFrame:
    """M1: share of last-tier predictions per tumbling hour."""
    g = log.groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.count("*").alias("n"), F.avg(F.col("tier_used").startswith("groq").cast("double")).alias("rate"))
    return g.select(fmt_ts(F.col("w.start")).alias("hour"), F.col("n").cast("long").alias("n"),
                    F.round("rate", ROUND).alias("tier3_rate"), (F.col("rate") > max_rate).alias("alert"))


def confidence_drift_weekly(log: DataFrame, max_drop: float = CONFIDENCE_DROP_MAX) -> DataFrame:
    """M2: mean confidence per (Monday-based) week and its drop from the previous week.

    The ``lag`` window runs over the weekly aggregate (one row per week)."""
    g = log.groupBy(F.date_trunc("week", "ts").alias("wk")).agg(F.avg("confidence").alias("m"))
    prev = F.lag("m").over(Window.orderBy("wk"))
    drop = (prev - F.col("m")) / prev
    return g.select(fmt_ts("wk").alias("week"), F.round("m", ROUND).alias("mean_confidence"),
                    F.round(drop, ROUND).alias("drop"), F.coalesce(drop > max_drop, F.lit(False)).alias("alert"))


def _daily_rate(log: DataFrame, cond: Column, name: str, alert: Column | None = None) -> DataFrame:
    g = log.groupBy(F.date_trunc("day", "ts").alias("d")).agg(
        F.count("*").alias("n"), F.avg(cond.cast("double")).alias("r"))
    return g.select(fmt_ts("d").alias("day"), F.col("n").cast("long").alias("n"),
                    F.round("r", ROUND).alias(name), alert.alias("alert") if alert is not None else F.lit(None))


def manual_review_rate(log: DataFrame, max_rate: float = MANUAL_REVIEW_MAX) -> DataFrame:
    """M3: daily share routed to manual review."""
    return _daily_rate(log, F.col("routing_action") == "manual_review", "manual_review_rate",
                       F.col("r") > max_rate)


def retrieval_score_hourly(log: DataFrame, min_score: float = RETRIEVAL_SCORE_MIN) -> DataFrame:
    """M4: mean retrieval max score per tumbling hour."""
    g = log.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.avg("retrieval_max_score").alias("m"))
    return g.select(fmt_ts(F.col("w.start")).alias("hour"), F.round("m", ROUND).alias("mean_score"),
                    (F.col("m") < min_score).alias("alert"))


def abstain_rate(log: DataFrame, max_rate: float = ABSTAIN_RATE_MAX) -> DataFrame:
    """M5: daily abstain share."""
    return _daily_rate(log, F.col("abstain"), "abstain_rate", F.col("r") > max_rate)


def citation_count(citations: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(citations, F.lit("")), r"\|"), lambda x: x != ""))


def citation_mean(log: DataFrame, min_mean: float = CITATIONS_MIN) -> DataFrame:
    """M6: daily mean number of citations per response."""
    g = log.groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.avg(citation_count(F.col("citations"))).alias("m"))
    return g.select(fmt_ts("d").alias("day"), F.round("m", ROUND).alias("mean_citations"),
                    (F.col("m") < min_mean).alias("alert"))


HISTOGRAM_BINS = 1000


def exact_percentile(rows: DataFrame, key: str, value: str, q: float, out: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``(key, out)``: the exact interpolated ``q`` quantile of each key's values, in bounded state.

    A histogram of each key says in which bins the two order statistics lie; then only these bins' values
    are looked at, equal ones added up first.  Nulls do not count; keys without a value get null.
    """
    rows = cut_lineage(rows.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")))
    ends = rows.groupBy(F.col("_k").alias("_e")).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("_v").alias("_n"))
    at = F.lit(q) * (F.col("_n") - 1)
    ends = cut_lineage(ends.withColumns({"_first": F.floor(at) + 1, "_second": F.ceil(at) + 1, "_part": at - F.floor(at)}))
    wide = F.col("_high") - F.col("_low")
    bin_of = F.when(wide > 0, F.least(F.floor((F.col("_v") - F.col("_low")) / wide * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    binned = rows.where("_v IS NOT NULL").join(ends, F.col("_k").eqNullSafe(F.col("_e"))).select(
        "_k", "_v", "_first", "_second", "_part", bin_of.alias("_bin"))
    counts = binned.groupBy("_k", "_first", "_second", "_bin").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_k").orderBy("_bin"))  # `bins` rows a key
    asked = cut_lineage(counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_c"))
                        .where((F.col("_before") < F.col("_second")) & (F.col("_upto") >= F.col("_first")))
                        .select(F.col("_k").alias("_a"), F.col("_bin").alias("_b"), "_before"))
    values = (binned.join(asked, F.col("_k").eqNullSafe(F.col("_a")) & (F.col("_bin") == F.col("_b")))  # one or two bins a key
              .groupBy("_k", "_first", "_second", "_part", "_bin", "_before", "_v").agg(F.count("*").alias("_c")))
    inside = Window.partitionBy("_k", "_bin").orderBy("_v")
    placed = values.withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))

    def held(place):
        return F.min(F.when((F.col("_upto") >= F.col(place)) & (F.col("_upto") - F.col("_c") < F.col(place)), F.col("_v")))
    two = placed.groupBy("_k").agg(held("_first").alias("_x"), held("_second").alias("_y"), F.first("_part").alias("_p"))
    found = two.select("_k", (F.col("_x") + (F.col("_y") - F.col("_x")) * F.col("_p")).alias(out))
    return ends.select("_e").join(found, F.col("_e").eqNullSafe(F.col("_k")), "left").select(F.col("_e").alias(key), out)


def latency_p95(log: DataFrame, max_ms: float = LATENCY_P95_MAX_MS, exact: bool = True) -> DataFrame:
    """M7: daily 95th percentile latency, interpolated between neighbours.

    ``exact=False`` (streams) uses ``percentile_approx``.
    """
    rows = log.select(F.date_trunc("day", "ts").alias("d"), "latency_ms")
    if exact:
        g = exact_percentile(rows, "d", "latency_ms", 0.95, "p95")
    else:
        g = rows.groupBy("d").agg(F.percentile_approx("latency_ms", 0.95, 10_000).cast("double").alias("p95"))
    return g.select(fmt_ts("d").alias("day"), F.round("p95", ROUND).alias("p95_ms"),
                    (F.col("p95") > max_ms).alias("alert"))


def api_error_rate(calls: DataFrame, error_class: Column, max_rate: float = ERROR_RATE_MAX) -> DataFrame:
    """M8: daily share of failed calls and the split by error class."""
    c = calls.withColumn("_cls", error_class)
    g = c.groupBy(F.date_trunc("day", "ts").alias("d")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_cls").isNotNull()).alias("n_err"),
        F.count_if(F.col("_cls") == "rate_limited").alias("n_rate_limited"),
        F.count_if(F.col("_cls") == "model_not_found").alias("n_model_not_found"))
    rate = F.col("n_err") / F.col("n")
    return g.select(fmt_ts("d").alias("day"), F.col("n").cast("long").alias("n"),
                    F.col("n_err").cast("long").alias("n_errors"),
                    F.col("n_rate_limited").cast("long").alias("n_rate_limited"),
                    F.col("n_model_not_found").cast("long").alias("n_model_not_found"),
                    F.round(rate, ROUND).alias("error_rate"), (rate > max_rate).alias("alert"))


def daily_cost(usage: DataFrame, budget_usd: float) -> DataFrame:
    """M9: cost per day, the running total, and whether the day exceeds the cap."""
    g = usage_cost(usage).groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.sum("cost_usd").alias("c"))
    run = F.sum("c").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    return g.select(fmt_ts("d").alias("day"), F.round("c", 12).alias("cost_usd"),
                    F.round(run, 12).alias("cumulative_usd"), (F.col("c") > budget_usd).alias("over_budget"))


def latest_feedback(feedback: DataFrame, only_corrections: bool = False) -> DataFrame:
    """The latest feedback row per ticket (later corrections supersede).

    ``max_by`` is a partial aggregate: a ticket with many events is combined
    map-side, never gathered into one task."""
    fb = feedback.where(F.col("corrected_category").isNotNull()) if only_corrections else feedback
    g = fb.groupBy("ticket_id").agg(F.max_by(F.struct("ts", "feedback_id", "corrected_category", "rating"),
                                             F.struct("ts", "feedback_id")).alias("l"))
    return g.select("ticket_id", fmt_ts("l.ts").alias("ts"), F.col("l.feedback_id").alias("feedback_id"),
                    F.col("l.corrected_category").alias("corrected_category"), F.col("l.rating").alias("rating"))


def feedback_accuracy_weekly(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """Weekly accuracy of predictions whose ticket has a correction (the latest)."""
    lf = latest_feedback(feedback, only_corrections=True).select("ticket_id", "corrected_category")
    j = log.join(lf, "ticket_id")
    g = j.groupBy(F.date_trunc("week", "ts").alias("wk")).agg(
        F.count("*").alias("n"),
        F.avg((F.col("predicted_category") == F.col("corrected_category")).cast("double")).alias("acc"))
    return g.select(fmt_ts("wk").alias("week"), F.col("n").cast("long").alias("n"),
                    F.round("acc", ROUND).alias("accuracy"))


def latency_compare(log: DataFrame, group_col: str = "tier_used") -> DataFrame:
    """Min / max latency per pipeline (here: per tier)."""
    return log.groupBy(group_col).agg(F.round(F.min("latency_ms"), ROUND).alias("min_latency_ms"),
                                      F.round(F.max("latency_ms"), ROUND).alias("max_latency_ms"),
                                      F.count("*").cast("long").alias("n"))
