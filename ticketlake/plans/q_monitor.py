"""Queries for monitoring (M1-M14), batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlake.operators import monitor as mo
from ticketlake.plans.common import Family
from ticketlake.plans.q_completions import ERROR_MESSAGES_SQL
from ticketlake.sources import logical as lg
from ticketlake.sources.tables import table
from ticketlake.streaming import streams as st

fam = Family()

PL = lg.with_ctes(lg.PREDICTION_LOG_SQL)
FMT = "'%Y-%m-%d %H:%M:%S'"
DAILY_BUDGET_USD = 0.03


@fam.add("tier3_rate_hourly", PL + f"""
SELECT strftime(date_trunc('hour', ts), {FMT}) AS hour, count(*) AS n,
       round(avg(CAST(starts_with(tier_used, 'groq') AS DOUBLE)), 9) AS tier3_rate,
       avg(CAST(starts_with(tier_used, 'groq') AS DOUBLE)) > 0.4 AS alert
FROM prediction_log GROUP BY ALL""")
def q_tier3_rate_hourly(spark, sf):
    return mo.tier3_rate_hourly(lg.prediction_log(spark, sf))


@fam.add("confidence_drift_weekly", PL + f"""
SELECT strftime(wk, {FMT}) AS week, round(m, 9) AS mean_confidence, round(d, 9) AS drop, coalesce(d > 0.1, FALSE) AS alert
FROM (SELECT wk, m, (lag(m) OVER (ORDER BY wk) - m) / lag(m) OVER (ORDER BY wk) AS d
      FROM (SELECT date_trunc('week', ts) AS wk, avg(confidence) AS m FROM prediction_log GROUP BY ALL))""")
def q_confidence_drift_weekly(spark, sf):
    return mo.confidence_drift_weekly(lg.prediction_log(spark, sf))


def _daily_sql(cond: str, name: str, alert: str) -> str:
    return PL + f"""
SELECT strftime(d, {FMT}) AS day, n, round(r, 9) AS {name}, {alert} AS alert
FROM (SELECT date_trunc('day', ts) AS d, count(*) AS n, avg(CAST({cond} AS DOUBLE)) AS r FROM prediction_log GROUP BY ALL)"""


@fam.add("manual_review_rate", _daily_sql("routing_action = 'manual_review'", "manual_review_rate", "r > 0.5"))
def q_manual_review_rate(spark, sf):
    return mo.manual_review_rate(lg.prediction_log(spark, sf))


@fam.add("retrieval_score_hourly", PL + f"""
SELECT strftime(date_trunc('hour', ts), {FMT}) AS hour, round(avg(retrieval_max_score), 9) AS mean_score,
       avg(retrieval_max_score) < 0.3 AS alert
FROM prediction_log GROUP BY ALL""")
def q_retrieval_score_hourly(spark, sf):
    return mo.retrieval_score_hourly(lg.prediction_log(spark, sf))


@fam.add("abstain_rate", _daily_sql("abstain", "abstain_rate", "r > 0.3"))
def q_abstain_rate(spark, sf):
    return mo.abstain_rate(lg.prediction_log(spark, sf))


@fam.add("citation_mean", PL + f"""
SELECT strftime(d, {FMT}) AS day, round(m, 9) AS mean_citations, m < 0.5 AS alert
FROM (SELECT date_trunc('day', ts) AS d,
             avg(len(list_filter(string_split(coalesce(citations, ''), '|'), lambda x: x <> ''))) AS m
      FROM prediction_log GROUP BY ALL)""")
def q_citation_mean(spark, sf):
    return mo.citation_mean(lg.prediction_log(spark, sf))


@fam.add("latency_p95", PL + f"""
SELECT strftime(d, {FMT}) AS day, round(p, 9) AS p95_ms, p > 10000.0 AS alert
FROM (SELECT date_trunc('day', ts) AS d, quantile_cont(latency_ms, 0.95) AS p FROM prediction_log GROUP BY ALL)""")
def q_latency_p95(spark, sf):
    return mo.latency_p95(lg.prediction_log(spark, sf))


@fam.add("api_error_rate", f"""
WITH calls AS (
  SELECT ts, CASE WHEN event_type <> 'error' THEN NULL
                  WHEN lower(message) LIKE '%rate%' OR lower(message) LIKE '%quota%' THEN 'rate_limited'
                  WHEN contains(message, 'NOT_FOUND') OR lower(message) LIKE '%not found%' THEN 'model_not_found'
                  ELSE 'other' END AS cls
  FROM (SELECT ts, event_type, {ERROR_MESSAGES_SQL} AS message FROM events))
SELECT strftime(d, {FMT}) AS day, n, n_errors, n_rate_limited, n_model_not_found,
       round(n_errors / n, 9) AS error_rate, n_errors / n > 0.05 AS alert
FROM (SELECT date_trunc('day', ts) AS d, count(*) AS n, count(cls) AS n_errors,
             count(*) FILTER (WHERE cls = 'rate_limited') AS n_rate_limited,
             count(*) FILTER (WHERE cls = 'model_not_found') AS n_model_not_found
      FROM calls GROUP BY ALL)""")
def q_api_error_rate(spark, sf):
    from ticketlake.operators.completions import classify_error
    ev = table(spark, sf, "events")
    k = F.col("event_id") % 5
    msg = F.concat((F.when(k == 0, "Rate limit reached for model qwen").when(k == 1, "Error code: 404 - NOT_FOUND")
                    .when(k == 2, "You exceeded your current Quota").when(k == 3, "The model was not found")
                    .otherwise("Connection reset by peer")), F.lit(" ("), F.col("props"), F.lit(")"))
    calls = ev.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", msg.alias("message"))
    cls = F.when(F.col("event_type") == "error", classify_error(F.col("message")))
    return mo.api_error_rate(calls, cls)


@fam.add("daily_cost", lg.with_ctes(lg.USAGE_SQL) + f"""
SELECT strftime(d, {FMT}) AS day, round(c, 12) AS cost_usd, round(sum(c) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 12) AS cumulative_usd,
       c > {DAILY_BUDGET_USD} AS over_budget
FROM (SELECT date_trunc('day', ts) AS d,
             sum(CAST(input_tokens AS DOUBLE) / 1000.0 * 0.00025 + CAST(output_tokens AS DOUBLE) / 1000.0 * 0.00125) AS c
      FROM usage GROUP BY ALL)""")
def q_daily_cost(spark, sf):
    return mo.daily_cost(lg.usage(spark, sf), DAILY_BUDGET_USD)


LATEST_SQL = """latest AS (
  SELECT ticket_id, ts, feedback_id, corrected_category, rating FROM feedback {where}
  QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY ts DESC, feedback_id DESC) = 1)"""


@fam.add("latest_feedback", lg.with_ctes(lg.FEEDBACK_SQL, LATEST_SQL.format(where="")) + f"""
SELECT ticket_id, strftime(ts, {FMT}) AS ts, feedback_id, corrected_category, rating FROM latest""")
def q_latest_feedback(spark, sf):
    return mo.latest_feedback(lg.feedback(spark, sf))


@fam.add("feedback_accuracy_weekly", lg.with_ctes(
    lg.PREDICTION_LOG_SQL, lg.FEEDBACK_SQL, LATEST_SQL.format(where="WHERE corrected_category IS NOT NULL")) + f"""
SELECT strftime(date_trunc('week', p.ts), {FMT}) AS week, count(*) AS n,
       round(avg(CAST(p.predicted_category = l.corrected_category AS DOUBLE)), 9) AS accuracy
FROM prediction_log p JOIN latest l USING (ticket_id) GROUP BY ALL""")
def q_feedback_accuracy_weekly(spark, sf):
    return mo.feedback_accuracy_weekly(lg.prediction_log(spark, sf), lg.feedback(spark, sf))


@fam.add("latency_compare", PL + """
SELECT tier_used, round(min(latency_ms), 9) AS min_latency_ms, round(max(latency_ms), 9) AS max_latency_ms, count(*) AS n
FROM prediction_log GROUP BY tier_used""")
def q_latency_compare(spark, sf):
    return mo.latency_compare(lg.prediction_log(spark, sf))


# ---- streams ------------------------------------------------------------------------------------

def _log_stream(spark, sf, dup: bool = False):
    log = lg.prediction_log(spark, sf)
    src = st.stage_as_stream_source(log.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "pl")
    s = st.read_stream(spark, src, log.withColumn("ts", F.col("ts").cast("timestamp_ntz")).schema)
    if dup:
        s = s.unionByName(st.read_stream(spark, src, log.withColumn("ts", F.col("ts").cast("timestamp_ntz")).schema)
                          .where(F.col("request_id") % 10 == 0))
    return s


@fam.add("prediction_log_stream", PL + """
SELECT DISTINCT request_id, ticket_id, tier_used, confidence FROM prediction_log""")
def q_prediction_log_stream(spark, sf):
    """Every 10th request arrives twice; the watermarked stream keeps one copy."""
    s = st.dedupe_prediction_stream(_log_stream(spark, sf, dup=True))
    out = st.run_available_now(s.select("request_id", "ticket_id", "tier_used", "confidence", "ts"), "m12")
    return out.select("request_id", "ticket_id", "tier_used", "confidence")


@fam.add("tier3_rate_stream", PL + f"""
SELECT strftime(date_trunc('hour', ts), {FMT}) AS hour, count(*) AS n,
       round(avg(CAST(starts_with(tier_used, 'groq') AS DOUBLE)), 9) AS tier3_rate,
       avg(CAST(starts_with(tier_used, 'groq') AS DOUBLE)) > 0.4 AS alert
FROM prediction_log GROUP BY ALL""")
def q_tier3_rate_stream(spark, sf):
    """M1 as a stream, open windows included (update mode)."""
    return st.run_latest(st.tier3_rate_stream(_log_stream(spark, sf)), "m1", ["hour"])


@fam.add("feedback_join_stream", lg.with_ctes(lg.PREDICTION_LOG_SQL, lg.FEEDBACK_SQL) + """
SELECT p.request_id, f.feedback_id, p.ticket_id, p.predicted_category, f.corrected_category
FROM prediction_log p JOIN feedback f
  ON p.ticket_id = f.ticket_id AND f.ts >= p.ts AND f.ts <= p.ts + INTERVAL 1 HOUR""")
def q_feedback_join_stream(spark, sf):
    """Stream-stream interval join, both sides watermarked."""
    fb = lg.feedback(spark, sf)
    fb_ntz = fb.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    fsrc = st.stage_as_stream_source(fb_ntz, "fb")
    fs = st.read_stream(spark, fsrc, fb_ntz.schema)
    j = st.feedback_join_stream(_log_stream(spark, sf), fs)
    return st.run_available_now(j, "m13")
