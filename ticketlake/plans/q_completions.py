"""Queries for model-completion tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlake.functions.text import normalize_ticket_text, strip_unicode
from ticketlake.functions import text as tx
from ticketlake.operators import completions as cp
from ticketlake.plans.common import Family, sql_str
from ticketlake.plans.q_text import sql_normalize_ticket_text, sql_strip
from ticketlake.sources import logical as lg
from ticketlake.sources.tables import table

fam = Family()

# ---- SQL building blocks -------------------------------------------------------------


THINK_BLOCK = r"<think>[\s\S]*?</think>"


def sql_strip_think(raw: str) -> str:
    t0 = sql_strip(f"coalesce({raw}, '')")
    removed = sql_strip(f"regexp_replace({t0}, {sql_str(THINK_BLOCK)}, '', 'g')")
    return f"CASE WHEN instr({t0}, '<think>') > 0 THEN {removed} ELSE {t0} END"


def sql_strip_fence(t: str) -> str:
    u = f"regexp_replace({t}, '^`+|`+$', '', 'g')"
    untagged = f"CASE WHEN starts_with(lower({u}), 'json') THEN {sql_strip(f'substr({u}, 5)')} ELSE {u} END"
    return f"CASE WHEN starts_with({t}, '```') THEN {untagged} ELSE {t} END"


ACTIONS_SQL = ", ".join(sql_str(a) for a in lg.ROUTING_ACTIONS)


def _class_parsed_sql() -> str:
    return lg.with_ctes(lg.CLASS_COMPLETIONS_SQL) + f""", c0 AS (
  SELECT ticket_id, attempt, {sql_strip_think('raw')} AS t0 FROM class_completions),
c1 AS (SELECT ticket_id, attempt, CASE WHEN starts_with(t0, '<think>') THEN '' ELSE t0 END AS t1 FROM c0),
c AS (SELECT ticket_id, attempt, {sql_strip_fence('t1')} AS t FROM c1),
p AS (
  SELECT ticket_id, attempt, t, json_valid(t) AND t <> '' AS js,
         CASE WHEN json_valid(t) THEN json_extract_string(t, '$.predicted_category') END AS cat,
         CASE WHEN json_valid(t) THEN json_extract_string(t, '$.predicted_priority') END AS pri,
         CASE WHEN json_valid(t) THEN TRY_CAST(json_extract(t, '$.confidence_score') AS DOUBLE) END AS conf,
         CASE WHEN json_valid(t) THEN TRY_CAST(json_extract(t, '$.abstain_flag') AS BOOLEAN) END AS abst,
         CASE WHEN json_valid(t) THEN json_extract_string(t, '$.routing_action') END AS act
  FROM c),
r AS (
  SELECT *, CASE WHEN lower(trim(coalesce(act, ''))) IN ({ACTIONS_SQL}) THEN act
                 WHEN coalesce(abst, FALSE) THEN 'manual_review'
                 WHEN coalesce(conf, 0.0) >= 0.9 THEN 'auto_route'
                 WHEN coalesce(conf, 0.0) >= 0.65 THEN 'suggest' ELSE 'manual_review' END AS route
  FROM p),
v AS (SELECT *, coalesce(js AND cat IS NOT NULL AND pri IS NOT NULL AND route IN ({ACTIONS_SQL}), FALSE) AS valid FROM r)"""


def _answer_parsed_sql() -> str:
    return lg.with_ctes(lg.ANSWER_COMPLETIONS_SQL) + f""", c0 AS (
  SELECT ticket_id, attempt, {sql_strip_think('raw')} AS t0 FROM answer_completions),
c AS (SELECT ticket_id, attempt, starts_with(t0, '<think>') AS truncated, {sql_strip_fence('t0')} AS t FROM c0),
p AS (
  SELECT ticket_id, attempt, truncated,
         CASE WHEN json_valid(t) THEN json_extract_string(t, '$.draft_response') END AS draft0,
         CASE WHEN json_valid(t) THEN TRY_CAST(json_extract(t, '$.citations') AS INTEGER[]) END AS cits
  FROM c),
q AS (SELECT *, {sql_strip('draft0')} AS draft FROM p),
v AS (
  SELECT ticket_id, attempt, draft, cits,
         coalesce(NOT truncated AND draft0 IS NOT NULL AND cits IS NOT NULL
                  AND len(list_filter(cits, lambda x: x NOT IN (0, 1, 2))) = 0
                  AND ((len(cits) > 0) = (draft <> '')), FALSE) AS valid
  FROM q)"""


# ---- queries -----------------------------------------------------------------------------

@fam.add("build_class_prompt", lg.with_ctes(lg.TICKETS_SQL) + f"""
SELECT t.ticket_id,
       {sql_str(cp.CLASS_PROMPT_HEAD)} || 'Ticket:' || chr(10) || {sql_strip(sql_normalize_ticket_text('t.description'))}
       || chr(10) || chr(10) || 'Reference knowledge base (excerpt):' || chr(10) || substr(k.kb, 1, 3000)
       || chr(10) || chr(10)
       || {sql_str('Valid categories (pick exactly one): [' + cp._quoted_list(lg.CATEGORIES) + ']')} || chr(10)
       || {sql_str('Valid priorities (pick exactly one): [' + cp._quoted_list(lg.PRIORITIES) + ']')} || chr(10) || chr(10)
       || {sql_str(cp.CLASS_PROMPT_TAIL)} AS prompt
FROM tickets t, (SELECT string_agg(substr(text, 1, 3000), chr(10) || chr(10) ORDER BY doc_id) AS kb FROM (
  SELECT doc_id, coalesce(text, '') AS text FROM documents ORDER BY doc_id LIMIT 3000)) k""")
def q_build_class_prompt(spark, sf):
    from ticketlake.operators.retrieval import attach_scalars
    j = attach_scalars(lg.tickets(spark, sf), cp.kb_excerpt(table(spark, sf, "documents")))
    return j.select("ticket_id", cp.class_prompt(normalize_ticket_text(F.col("description")), F.col("kb")).alias("prompt"))


@fam.add("build_answer_prompt", f"""
WITH src AS (
  SELECT conv_id, string_agg('Source ' || CAST(rn - 1 AS VARCHAR) || ':' || chr(10) || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY rn) AS body
  FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn
        FROM conversations WHERE turn >= 1) GROUP BY conv_id),
tk AS (SELECT conv_id, text FROM conversations WHERE turn = 0)
SELECT tk.conv_id AS ticket_id,
       CASE WHEN tk.conv_id % 2 = 1 THEN {sql_str(cp.ANSWER_SYSTEM_PROMPT + chr(10) + chr(10) + cp.ANSWER_RETRY_ADDITION)}
            ELSE {sql_str(cp.ANSWER_SYSTEM_PROMPT)} END AS system_prompt,
       'Sources:' || chr(10) || coalesce(src.body, '') || 'Support ticket:' || chr(10) || tk.text || chr(10) || chr(10)
       || 'Answer the ticket using only the sources above.' AS user_message
FROM tk LEFT JOIN src ON tk.conv_id = src.conv_id""")
def q_build_answer_prompt(spark, sf):
    cv = table(spark, sf, "conversations")
    tickets = cv.where(F.col("turn") == 0).select(
        F.col("conv_id").alias("ticket_id"), F.col("text").alias("ticket_text"),
        (F.col("conv_id") % 2 == 1).alias("is_retry"))
    sources = cv.where(F.col("turn") >= 1).select(F.col("conv_id").alias("ticket_id"),
                                                  F.col("turn").alias("rank"), "text")
    return cp.build_answer_prompt(tickets, sources, retry_col="is_retry", k=None)


@fam.add("strip_think", lg.with_ctes(lg.ANSWER_COMPLETIONS_SQL) + f"""
SELECT ticket_id, attempt, t AS text, starts_with(t, '<think>') AS truncated
FROM (SELECT ticket_id, attempt, {sql_strip_think('raw')} AS t FROM answer_completions)""")
def q_strip_think(spark, sf):
    c = lg.answer_completions(spark, sf)
    t, tr = cp.strip_think(F.col("raw"))
    return c.select("ticket_id", "attempt", t.alias("text"), tr.alias("truncated"))


@fam.add("strip_fence", lg.with_ctes(lg.CLASS_COMPLETIONS_SQL) + f"""
SELECT ticket_id, attempt, {sql_strip_fence('t')} AS text
FROM (SELECT ticket_id, attempt, {sql_strip_think('raw')} AS t FROM class_completions)""")
def q_strip_fence(spark, sf):
    c = lg.class_completions(spark, sf)
    t, _ = cp.strip_think(F.col("raw"))
    return c.select("ticket_id", "attempt", cp.strip_fence(t).alias("text"))


@fam.add("parse_prediction", _class_parsed_sql() + """
SELECT ticket_id, attempt, valid,
       CASE WHEN valid THEN cat END AS predicted_category, CASE WHEN valid THEN pri END AS predicted_priority,
       CASE WHEN valid THEN conf END AS confidence_score, CASE WHEN valid THEN abst END AS abstain_flag,
       CASE WHEN valid THEN route END AS routing_action
FROM v""")
def q_parse_prediction(spark, sf):
    return cp.parse_prediction(lg.class_completions(spark, sf))


@fam.add("normalize_route", _class_parsed_sql() + """
SELECT ticket_id, attempt, act AS raw_action, route AS routing_action FROM v WHERE js""")
def q_normalize_route(spark, sf):
    c = lg.class_completions(spark, sf)
    text, _ = cp.clean_response(F.col("raw"), truncated_as_empty=True)
    p = F.from_json(text, cp.CLASS_SCHEMA)
    return (c.where((text != "") & p.isNotNull())
             .select("ticket_id", "attempt", p["routing_action"].alias("raw_action"),
                     cp.normalize_route(p["routing_action"], p["abstain_flag"], p["confidence_score"])
                     .alias("routing_action")))


@fam.add("parse_answer", _answer_parsed_sql() + """
SELECT ticket_id, attempt, valid, CASE WHEN valid THEN draft END AS draft_response,
       CASE WHEN valid THEN cits END AS citations
FROM v""")
def q_parse_answer(spark, sf):
    return cp.parse_answer(lg.answer_completions(spark, sf))


@fam.add("first_valid_attempt", _answer_parsed_sql() + f""",
best AS (
  SELECT ticket_id, attempt, draft, cits FROM v WHERE attempt < 3 AND valid AND len(cits) > 0
  QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY attempt) = 1)
SELECT t.ticket_id, b.attempt AS chosen_attempt, b.attempt IS NULL AS abstain_flag,
       coalesce(b.draft, {sql_str(cp.ABSTAIN_RESPONSE_TEXT)}) AS draft_response,
       CASE WHEN b.attempt IS NULL THEN '' ELSE array_to_string(b.cits, '|') END AS citations
FROM (SELECT DISTINCT ticket_id FROM v) t LEFT JOIN best b ON t.ticket_id = b.ticket_id""")
def q_first_valid_attempt(spark, sf):
    return cp.first_valid_attempt(cp.parse_answer(lg.answer_completions(spark, sf)))


def _sql_hyp(turn_expr: str) -> str:
    t0 = sql_strip_think(turn_expr)
    return f"CASE WHEN starts_with({t0}, '<think>') THEN '' ELSE {t0} END"


@fam.add("expand_queries", f"""
WITH g AS (
  SELECT conv_id,
         max(CASE WHEN turn = 0 THEN text END) AS orig,
         max(CASE WHEN turn = 1 THEN text END) AS h1,
         max(CASE WHEN turn = 2 AND conv_id % 3 <> 0 THEN text WHEN turn = 2 THEN '' END) AS h2
  FROM conversations WHERE turn <= 2 GROUP BY conv_id),
q AS (
  SELECT conv_id, ([{sql_strip("coalesce(orig, '')")}] ||
         list_filter([{_sql_hyp('h1')}, {_sql_hyp('h2')}], lambda x: x IS NOT NULL AND x <> ''))[1:3] AS qs
  FROM g)
SELECT conv_id AS ticket_id, CAST(i - 1 AS INTEGER) AS query_no, qs[i] AS query
FROM q, range(1, 4) r(i) WHERE i <= len(qs)""")
def q_expand_queries(spark, sf):
    cv = table(spark, sf, "conversations")
    orig = cv.where("turn = 0").groupBy(F.col("conv_id").alias("ticket_id")).agg(F.max("text").alias("orig"))
    g = cv.where("turn <= 2").select(F.col("conv_id").alias("ticket_id")).distinct().join(orig, "ticket_id", "left").join(
        hypotheticals(cv), "ticket_id", "left")
    qs = cp.expand_queries(F.coalesce(F.col("orig"), F.lit("")), F.coalesce("texts", F.array().cast("array<string>")))
    return g.select("ticket_id", F.posexplode(qs).alias("query_no", "query"))


def hypotheticals(conversations):
    """``(ticket_id, texts)``: the replies of a conversation's turns 1 and 2 (of two thirds of them) stand for the
    hypothetical answers to its ticket, thinking stripped."""
    def hyp(c):
        txt, tr = cp.strip_think(c)
        return F.when(c.isNull(), F.lit("")).when(tr, F.lit("")).otherwise(txt)
    t = F.col("turn")
    g = conversations.where("turn IN (1, 2)").groupBy(F.col("conv_id").alias("ticket_id")).agg(
        F.max(F.when(t == 1, F.col("text"))).alias("h1"),
        F.max(F.when((t == 2) & (F.col("conv_id") % 3 != 0), F.col("text")).when(t == 2, F.lit(""))).alias("h2"))
    return g.select("ticket_id", F.array(hyp(F.col("h1")), hyp(F.col("h2"))).alias("texts"))


@fam.add("parse_verdict", """
SELECT conv_id AS ticket_id, turn,
       coalesce(regexp_replace(string_split_regex(regexp_replace(lower(coalesce(v, '')), '^<ws>+|<ws>+$', '', 'g'), '<ws>+')[1],
                '^[.,!?:;"''()\\[\\]{}]+|[.,!?:;"''()\\[\\]{}]+$', '', 'g') = 'relevant', FALSE) AS is_relevant
FROM (SELECT conv_id, turn,
             CASE conv_id % 4 WHEN 0 THEN 'Relevant. ' WHEN 1 THEN 'irrelevant ' WHEN 2 THEN '"RELEVANT": ' ELSE '' END || text AS v
      FROM conversations WHERE role = 'assistant')""".replace("<ws>", tx.SPACE))
def q_parse_verdict(spark, sf):
    cv = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    k = F.col("conv_id") % 4
    prefix = (F.when(k == 0, "Relevant. ").when(k == 1, "irrelevant ").when(k == 2, '"RELEVANT": ')
              .otherwise(""))
    return cv.select(F.col("conv_id").alias("ticket_id"), "turn",
                     cp.parse_verdict(F.concat(prefix, F.col("text"))).alias("is_relevant"))


ERROR_MESSAGES_SQL = """CASE event_id % 5
  WHEN 0 THEN 'Rate limit reached for model qwen'
  WHEN 1 THEN 'Error code: 404 - NOT_FOUND'
  WHEN 2 THEN 'You exceeded your current Quota'
  WHEN 3 THEN 'The model was not found'
  ELSE 'Connection reset by peer' END || ' (' || props || ')'"""


def error_messages(spark, sf):
    ev = table(spark, sf, "events").where(F.col("event_type") == "error")
    k = F.col("event_id") % 5
    msg = (F.when(k == 0, "Rate limit reached for model qwen").when(k == 1, "Error code: 404 - NOT_FOUND")
           .when(k == 2, "You exceeded your current Quota").when(k == 3, "The model was not found")
           .otherwise("Connection reset by peer"))
    return ev.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                     F.concat(msg, F.lit(" ("), F.col("props"), F.lit(")")).alias("message"))


@fam.add("classify_errors", f"""
SELECT event_id, message,
       CASE WHEN lower(message) LIKE '%rate%' OR lower(message) LIKE '%quota%' THEN 'rate_limited'
            WHEN contains(message, 'NOT_FOUND') OR lower(message) LIKE '%not found%' THEN 'model_not_found'
            ELSE 'other' END AS error_class
FROM (SELECT event_id, {ERROR_MESSAGES_SQL} AS message FROM events WHERE event_type = 'error')""")
def q_classify_errors(spark, sf):
    e = error_messages(spark, sf)
    return e.select("event_id", "message", cp.classify_error(F.col("message")).alias("error_class"))


__all__ = ["fam", "strip_unicode"]
