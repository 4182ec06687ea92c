"""Logical inputs of the triage domain, bound to the driver tables.

Each binding exists twice: as a DataFrame builder (what the library runs) and as
an SQL common-table expression (what the DuckDB oracle runs).  Both are built
from ids only, so the two engines see identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.session import spread
from ticketlake.sources.tables import table

# The label domains of the triage chain.
CATEGORIES = ["Billing inquiry", "Cancellation request", "Product inquiry",
              "Refund request", "Technical issue"]
PRIORITIES = ["Critical", "High", "Medium", "Low"]
ROUTING_ACTIONS = ["auto_route", "suggest", "manual_review", "escalate_to_tier2", "escalate_to_tier3"]


def _sql_array(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CATEGORIES_SQL = _sql_array(CATEGORIES)
PRIORITIES_SQL = _sql_array(PRIORITIES)


def pick(values: list[str], idx: Column) -> Column:
    """``values[idx]`` with a 0-based integer column (same as SQL ``list[idx + 1]``)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def permille(expr: Column) -> Column:
    """Deterministic stand-in score in [0, 1): ``(expr % 1000) / 1000``."""
    return (expr % 1000).cast("double") / F.lit(1000.0)


# --------------------------------------------------------------------------------
# tickets(ticket_id, description, category, priority)
# --------------------------------------------------------------------------------

def tickets(spark: SparkSession, sf_dir: str, with_priority: bool = False) -> DataFrame:
    """Tickets from ``documents``; the priority needs a join with ``labels``, made only on request."""
    docs = spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("ticket_id"), F.col("text").alias("description"),
        F.col("lang").alias("category"))
    return join_priority(spark, sf_dir, docs) if with_priority else docs


# Labels, an id and a priority each, that go to every task, so that texts are not shuffled to meet them.
BROADCAST_LABELS = 2_000_000


def join_priority(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Adds the priority that the labels give a ticket; null without a label."""
    labels = table(spark, sf_dir, "labels")
    q, t = F.col("quality"), F.col("toxic")
    priority = (F.when((q == 1) & (t == 0), "Low").when((q == 0) & (t == 0), "Medium")
                .when((q == 1) & (t == 1), "High").when((q == 0) & (t == 1), "Critical"))
    lab = labels.select(F.col("doc_id").alias("ticket_id"), priority.alias("priority"))
    return docs.join(F.broadcast(lab) if labels.count() <= BROADCAST_LABELS else lab, "ticket_id", "left")


TICKETS_SQL = """tickets AS (
  SELECT d.doc_id AS ticket_id, d.text AS description, d.lang AS category,
         CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'Low'
              WHEN l.quality = 0 AND l.toxic = 0 THEN 'Medium'
              WHEN l.quality = 1 AND l.toxic = 1 THEN 'High'
              WHEN l.quality = 0 AND l.toxic = 1 THEN 'Critical' END AS priority
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


# --------------------------------------------------------------------------------
# usage(component, input_tokens, output_tokens, ticket_id, ts)  <- events
# --------------------------------------------------------------------------------

def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("component"),
        F.floor(F.col("value") * 10).cast("long").alias("input_tokens"),
        (F.col("event_id") % 300).alias("output_tokens"),
        F.when(F.col("event_id") % 17 == 0, F.lit(None).cast("long"))
         .otherwise(F.col("user_id")).alias("ticket_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("call_id"))


USAGE_SQL = """usage AS (
  SELECT event_type AS component,
         CAST(floor(value * 10) AS BIGINT) AS input_tokens,
         event_id % 300 AS output_tokens,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS ticket_id,
         ts, event_id AS call_id
  FROM events)"""


# --------------------------------------------------------------------------------
# prediction_log(request_id, ts, ticket_id, predicted_category, tier_used,
#                routing_action, confidence, abstain, citations,
#                retrieval_max_score, latency_ms)  <- events
# --------------------------------------------------------------------------------

TIER_NAMES = ["logreg", "setfit", "groq:qwen/qwen3-32b"]


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    conf = permille(eid * 7919)
    return ev.select(
        eid.alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("ticket_id"),
        pick(CATEGORIES, (eid * 7) % 5).alias("predicted_category"),
        pick(TIER_NAMES, eid % 3).alias("tier_used"),
        F.when(conf >= 0.90, "auto_route").when(conf >= 0.65, "suggest")
         .otherwise("manual_review").alias("routing_action"),
        conf.alias("confidence"),
        (eid % 4 == 0).alias("abstain"),
        F.when(eid % 4 == 0, "").when(eid % 4 == 1, "0").when(eid % 4 == 2, "0|1")
         .otherwise("0|1|2").alias("citations"),
        permille(eid * 104729).alias("retrieval_max_score"),
        (F.col("value") * 100).alias("latency_ms"),
        F.col("event_type").alias("event_type"))


PREDICTION_LOG_SQL = f"""prediction_log AS (
  SELECT event_id AS request_id, ts, user_id AS ticket_id,
         {CATEGORIES_SQL}[(event_id * 7) % 5 + 1] AS predicted_category,
         {_sql_array(TIER_NAMES)}[event_id % 3 + 1] AS tier_used,
         CASE WHEN CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000.0 >= 0.90 THEN 'auto_route'
              WHEN CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000.0 >= 0.65 THEN 'suggest'
              ELSE 'manual_review' END AS routing_action,
         CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS confidence,
         (event_id % 4 = 0) AS abstain,
         CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '0|1' ELSE '0|1|2' END AS citations,
         CAST((event_id * 104729) % 1000 AS DOUBLE) / 1000.0 AS retrieval_max_score,
         value * 100 AS latency_ms,
         event_type
  FROM events)"""


# --------------------------------------------------------------------------------
# feedback(ticket_id, ts, corrected_category, rating, feedback_id) <- click events
# --------------------------------------------------------------------------------

def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "click")
    eid = F.col("event_id")
    return ev.select(
        F.col("user_id").alias("ticket_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(eid % 3 == 0, F.lit(None).cast("string"))
         .otherwise(pick(CATEGORIES, (eid * 11) % 5)).alias("corrected_category"),
        (eid % 5 + 1).alias("rating"),
        eid.alias("feedback_id"))


FEEDBACK_SQL = f"""feedback AS (
  SELECT user_id AS ticket_id, ts,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE {CATEGORIES_SQL}[(event_id * 11) % 5 + 1] END
           AS corrected_category,
         event_id % 5 + 1 AS rating, event_id AS feedback_id
  FROM events WHERE event_type = 'click')"""


# --------------------------------------------------------------------------------
# tier_scores: deterministic stand-ins for the three classifier tiers
# --------------------------------------------------------------------------------

def tier_scores(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Per ticket: tier-1 model + rule results and tier-2 / tier-3 results, from ids
    (the document ids unless another id column ``doc_id`` is given)."""
    src = ids if ids is not None else table(spark, sf_dir, "documents")
    d = src.select(F.col("doc_id").alias("ticket_id"))
    i = F.col("ticket_id")
    rule = ((i * 31) % 11).cast("double") / F.lit(10.0)
    return d.select(
        i,
        pick(CATEGORIES, i % 5).alias("t1_cat"), permille(i * 7919).alias("t1_cat_conf"),
        pick(PRIORITIES, i % 4).alias("t1_pri"), permille(i * 104729).alias("t1_pri_conf"),
        pick(CATEGORIES, (i * 3) % 5).alias("rule_cat"),
        F.when(rule > 0, rule).alias("rule_cat_conf"),
        pick(CATEGORIES, (i * 7) % 5).alias("t2_cat"), permille(i * 7907).alias("t2_cat_conf"),
        pick(PRIORITIES, (i * 3) % 4).alias("t2_pri"), permille(i * 15485863).alias("t2_pri_conf"),
        pick(CATEGORIES, (i * 13) % 5).alias("t3_cat"),
        pick(PRIORITIES, (i * 5) % 4).alias("t3_pri"), permille(i * 6151).alias("t3_conf"),
    )


TIER_SCORES_SQL = f"""tier_scores AS (
  SELECT doc_id AS ticket_id,
         {CATEGORIES_SQL}[doc_id % 5 + 1] AS t1_cat,
         CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS t1_cat_conf,
         {PRIORITIES_SQL}[doc_id % 4 + 1] AS t1_pri,
         CAST((doc_id * 104729) % 1000 AS DOUBLE) / 1000.0 AS t1_pri_conf,
         {CATEGORIES_SQL}[(doc_id * 3) % 5 + 1] AS rule_cat,
         CASE WHEN (doc_id * 31) % 11 > 0 THEN CAST((doc_id * 31) % 11 AS DOUBLE) / 10.0 END AS rule_cat_conf,
         {CATEGORIES_SQL}[(doc_id * 7) % 5 + 1] AS t2_cat,
         CAST((doc_id * 7907) % 1000 AS DOUBLE) / 1000.0 AS t2_cat_conf,
         {PRIORITIES_SQL}[(doc_id * 3) % 4 + 1] AS t2_pri,
         CAST((doc_id * 15485863) % 1000 AS DOUBLE) / 1000.0 AS t2_pri_conf,
         {CATEGORIES_SQL}[(doc_id * 13) % 5 + 1] AS t3_cat,
         {PRIORITIES_SQL}[(doc_id * 5) % 4 + 1] AS t3_pri,
         CAST((doc_id * 6151) % 1000 AS DOUBLE) / 1000.0 AS t3_conf
  FROM documents)"""


# --------------------------------------------------------------------------------
# completions(ticket_id, attempt, raw): model outputs with think/fence/JSON shapes
# --------------------------------------------------------------------------------

def _s(c: Column) -> Column:
    return c.cast("string")


def answer_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer-generation outputs: conversation id = ticket, turn = attempt."""
    cv = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    c, t = F.col("conv_id"), F.col("turn")
    body = F.when((c + t) % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit("  Answer for ticket "), _s(c), F.lit(" attempt "), _s(t), F.lit(" ")))
    k = (c * 3 + t) % 6
    cits = (F.when(k == 0, "").when(k == 1, "0").when(k == 2, "1, 2").when(k == 3, "0, 3")
            .when(k == 4, "2").otherwise("0, 1, 2"))
    js = F.concat(F.lit('{"draft_response": "'), body, F.lit('", "citations": ['), cits, F.lit("]}"))
    shape = t % 4
    raw = (F.when(shape == 0, js)
           .when(shape == 1, F.concat(F.lit("<think>checking the sources</think>\n"), js))
           .when(shape == 2, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
           .otherwise(F.concat(F.lit("<think>reasoning cut off at the token limit "), _s(c))))
    return cv.select(c.alias("ticket_id"), t.alias("attempt"), raw.alias("raw"))


ANSWER_COMPLETIONS_SQL = """answer_completions AS (
  SELECT conv_id AS ticket_id, turn AS attempt,
         CASE turn % 4
           WHEN 0 THEN js
           WHEN 1 THEN '<think>checking the sources</think>' || chr(10) || js
           WHEN 2 THEN '```json' || chr(10) || js || chr(10) || '```'
           ELSE '<think>reasoning cut off at the token limit ' || CAST(conv_id AS VARCHAR) END AS raw
  FROM (
    SELECT conv_id, turn,
           '{"draft_response": "' ||
           CASE WHEN (conv_id + turn) % 5 = 0 THEN ''
                ELSE '  Answer for ticket ' || CAST(conv_id AS VARCHAR) || ' attempt ' || CAST(turn AS VARCHAR) || ' ' END ||
           '", "citations": [' ||
           CASE (conv_id * 3 + turn) % 6 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '1, 2'
                WHEN 3 THEN '0, 3' WHEN 4 THEN '2' ELSE '0, 1, 2' END || ']}' AS js
    FROM conversations) x)"""


def class_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier-3 classification outputs, one per conversation turn."""
    cv = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    c, t = F.col("conv_id"), F.col("turn")
    x = c * 7 + t
    conf_txt = F.concat(F.lit("0."), F.lpad(_s((c * 7919 + t) % 1000), 3, "0"))
    actions = ROUTING_ACTIONS + ["respond_with_kb", "Auto_Route "]
    js = F.concat(
        F.lit('{"predicted_category": "'), pick(CATEGORIES, x % 5),
        F.lit('", "predicted_priority": "'), pick(PRIORITIES, x % 4),
        F.lit('", "confidence_score": '), conf_txt,
        F.lit(', "tier_used": "groq", "abstain_flag": '),
        F.when(x % 3 == 0, "true").otherwise("false"),
        F.when(x % 11 == 0, F.lit("}")).otherwise(
            F.concat(F.lit(', "routing_action": "'), pick(actions, x % 7), F.lit('"}'))))
    shape = t % 4
    raw = (F.when(shape == 0, js)
           .when(shape == 1, F.concat(F.lit("<think>weighing the labels</think>\n"), js))
           .when(shape == 2, F.concat(F.lit("```JSON\n"), js, F.lit("\n```")))
           .otherwise(F.lit("<think>unfinished")))
    return cv.select(c.alias("ticket_id"), t.alias("attempt"), raw.alias("raw"))


CLASS_COMPLETIONS_SQL = f"""class_completions AS (
  SELECT conv_id AS ticket_id, turn AS attempt,
         CASE turn % 4
           WHEN 0 THEN js
           WHEN 1 THEN '<think>weighing the labels</think>' || chr(10) || js
           WHEN 2 THEN '```JSON' || chr(10) || js || chr(10) || '```'
           ELSE '<think>unfinished' END AS raw
  FROM (
    SELECT conv_id, turn,
      '{{"predicted_category": "' || {CATEGORIES_SQL}[(conv_id * 7 + turn) % 5 + 1] ||
      '", "predicted_priority": "' || {PRIORITIES_SQL}[(conv_id * 7 + turn) % 4 + 1] ||
      '", "confidence_score": 0.' || lpad(CAST((conv_id * 7919 + turn) % 1000 AS VARCHAR), 3, '0') ||
      ', "tier_used": "groq", "abstain_flag": ' ||
      CASE WHEN (conv_id * 7 + turn) % 3 = 0 THEN 'true' ELSE 'false' END ||
      CASE WHEN (conv_id * 7 + turn) % 11 = 0 THEN '}}'
           ELSE ', "routing_action": "' ||
                {_sql_array(ROUTING_ACTIONS + ["respond_with_kb", "Auto_Route "])}[(conv_id * 7 + turn) % 7 + 1]
                || '"}}' END AS js
    FROM conversations) x)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
