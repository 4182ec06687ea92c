"""Operators over model-completion tables.

The hosted model itself is out of scope; its inputs (prompts) and outputs
(raw completions) are columns, and everything here is JSON / string functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.functions.text import SPACE, strip_unicode
from ticketlake.sources.logical import CATEGORIES, PRIORITIES, ROUTING_ACTIONS

# ---------------------------------------------------------------------------------
# Prompt templates and the refusal text (must equal the reference).
# ---------------------------------------------------------------------------------
ABSTAIN_RESPONSE_TEXT = (
    "Insufficient information in the knowledge base to answer this "
    "question. Please escalate to a human agent."
)
MAX_KB_CHARS = 3000
CLASS_PROMPT_HEAD = "Classify this support ticket into one of the given categories and priorities.\n\n"
CLASS_PROMPT_TAIL = (
    "Return JSON with fields: "
    "predicted_category, predicted_priority, confidence_score, tier_used, abstain_flag, routing_action.\n"
    "predicted_category MUST be one of the valid categories listed above.\n"
    "predicted_priority MUST be one of the valid priorities listed above.\n"
    "For this node set tier_used to 'groq'.\n"
    "If confidence is low, set abstain_flag=true and routing_action='manual_review'."
)
ANSWER_SYSTEM_PROMPT = """
You are a customer support agent. Answer the user's support ticket using
ONLY the information provided in the sources below. Do not use any knowledge
outside of these sources.

Rules:
- Base your response solely on the provided sources
- Be concise and directly address the user's issue
- You MUST cite which source numbers you used
- If the sources do not contain enough information to answer, say so clearly
  and do not invent an answer

You MUST respond with valid JSON matching this exact schema:
{
  "draft_response": "<your response text here>",
  "citations": [<list of integer source indices you used, e.g. 0, 1, 2>]
}

Return ONLY the JSON object. No markdown, no code fences, no extra text.
""".strip()
ANSWER_RETRY_ADDITION = """
IMPORTANT: Your previous response was not valid JSON or did not include citations.
You MUST return valid JSON with this exact format:
{"draft_response": "your answer", "citations": [0, 1]}
The citations array MUST contain at least one source index. This is mandatory.
""".strip()
VALID_CITATIONS = [0, 1, 2]
MAX_ATTEMPTS = 3


# ---- L1 / L2: prompt columns -------------------------------------------------------

def _quoted_list(values: list[str]) -> str:
    return ", ".join(f'"{v}"' for v in values)


def class_prompt(ticket_text: Column, kb_text: Column, kb_chars: int | None = None) -> Column:
    """L1: classification prompt: ticket, knowledge base (its first ``kb_chars`` characters, if given),
    label lists inlined."""
    kb_text = kb_text if kb_chars is None else F.substring(kb_text, 1, kb_chars)
    return F.concat(
        F.lit(CLASS_PROMPT_HEAD),
        F.lit("Ticket:\n"), strip_unicode(ticket_text), F.lit("\n\n"),
        F.lit("Reference knowledge base (excerpt):\n"), kb_text, F.lit("\n\n"),
        F.lit(f"Valid categories (pick exactly one): [{_quoted_list(CATEGORIES)}]\n"),
        F.lit(f"Valid priorities (pick exactly one): [{_quoted_list(PRIORITIES)}]\n\n"),
        F.lit(CLASS_PROMPT_TAIL))


def kb_excerpt(docs: DataFrame, chars: int = MAX_KB_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(kb)``, one row: the first ``chars`` characters of the whole knowledge base, its documents in the
    order of their ids, a blank line between two.

    A document adds a character at least (the line between two), so that no more than ``chars`` of them,
    each cut to ``chars``, are needed; every partition hands on its first ones.
    """
    some = (docs.select(F.col(id_col).alias("_id"), F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, chars).alias("_text"))
            .orderBy("_id", "_text").limit(chars))
    listed = some.agg(F.array_sort(F.collect_list(F.struct("_id", "_text"))).alias("_all"))
    return listed.select(F.substring(F.array_join(F.transform("_all", lambda d: d["_text"]), "\n\n"), 1, chars).alias("kb"))


def build_answer_prompt(tickets: DataFrame, sources: DataFrame, key: str = "ticket_id",
                        ticket_col: str = "ticket_text", retry_col: str | None = None, k: int | None = 3) -> DataFrame:
    """L2: ``Source i:`` blocks in rank order, then the ticket; on a retry the
    retry text is appended to the system part.

    ``sources`` is long format ``(key, rank, text)``; the ``k`` first of a ticket (the
    reranked top-k) are its blocks, however many it has; with ``k`` None all are.
    """
    from ticketlake.operators.evaluate import first_ranked
    blocks = ((sources if k is None else first_ranked(sources, key, k)).groupBy(key)
              .agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col("text")))).alias("_src")))
    joined = tickets.join(blocks, key, "left")
    src = F.coalesce(F.col("_src"), F.array().cast("array<struct<rank:bigint,text:string>>"))
    body = F.array_join(F.transform(src, lambda s, i: F.concat(
        F.lit("Source "), i.cast("string"), F.lit(":\n"), F.coalesce(s["text"], F.lit("")), F.lit("\n\n"))), "")
    user = F.concat(F.lit("Sources:\n"), body, F.lit("Support ticket:\n"), F.col(ticket_col),
                    F.lit("\n\nAnswer the ticket using only the sources above."))
    system = F.lit(ANSWER_SYSTEM_PROMPT)
    if retry_col is not None:
        system = F.when(F.col(retry_col), F.lit(ANSWER_SYSTEM_PROMPT + "\n\n" + ANSWER_RETRY_ADDITION)).otherwise(system)
    return joined.select(key, system.alias("system_prompt"), user.alias("user_message"))


# ---- L3 / L4: response clean-up -----------------------------------------------------

def strip_think(raw: Column) -> tuple[Column, Column]:
    """L3: drop closed ``<think>`` blocks; report an unclosed leading block.

    Returns ``(text, truncated)``: classifier and query expansion treat a
    truncated response as empty, answer generation treats it as invalid.
    """
    t = strip_unicode(F.coalesce(raw, F.lit("")))
    t = F.when(F.instr(t, "<think>") > 0,
               strip_unicode(F.regexp_replace(t, r"<think>[\s\S]*?</think>", ""))).otherwise(t)
    truncated = t.startswith("<think>")
    return t, truncated


def strip_fence(t: Column) -> Column:
    """L4: a fenced response loses its backticks and a leading ``json`` tag."""
    unfenced = F.regexp_replace(t, r"^`+|`+$", "")
    untagged = F.when(F.lower(unfenced).startswith("json"),
                      strip_unicode(F.substring(unfenced, 5, 1 << 30))).otherwise(unfenced)
    return F.when(t.startswith("```"), untagged).otherwise(t)


def clean_response(raw: Column, truncated_as_empty: bool) -> tuple[Column, Column]:
    t, truncated = strip_think(raw)
    if truncated_as_empty:
        t = F.when(truncated, F.lit("")).otherwise(t)
    return strip_fence(t), truncated


# ---- L5 / L6: classification JSON --------------------------------------------------

CLASS_SCHEMA = ("predicted_category string, predicted_priority string, confidence_score string, "
                "tier_used string, abstain_flag boolean, routing_action string")
CLASS_FIELDS = ("predicted_category: string, predicted_priority: string, confidence_score: string, "
                "tier_used: string, abstain_flag: boolean, routing_action: string")


def whole_json(text: Column, schema: str) -> Column:
    """The one JSON object that ``text`` consists of; null if anything stands beside it."""
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{schema}>>")
    return F.when(F.size(parsed) == 1, F.element_at(parsed, 1))


def normalize_route(action: Column, abstain: Column, conf: Column) -> Column:
    """An invented routing action is re-derived from abstain / confidence.
    A known action (after trim + lower-case) is kept exactly as written."""
    key = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    c = F.coalesce(conf, F.lit(0.0))
    derived = (F.when(F.coalesce(abstain, F.lit(False)), "manual_review")
               .when(c >= 0.90, "auto_route").when(c >= 0.65, "suggest").otherwise("manual_review"))
    return F.when(key.isin(ROUTING_ACTIONS), action).otherwise(derived)


def staged_clean(df: DataFrame, raw_col: str, truncated_as_empty: bool) -> DataFrame:
    """Clean-up in stages (one projection per step), so that a text referenced by
    several later expressions is computed once instead of copied into each."""
    t0 = strip_unicode(F.coalesce(F.col(raw_col), F.lit("")))
    df = df.withColumn("_t0", t0)
    df = df.withColumn("_t1", F.when(F.instr("_t0", "<think>") > 0, strip_unicode(
        F.regexp_replace("_t0", r"<think>[\s\S]*?</think>", ""))).otherwise(F.col("_t0")))
    df = df.withColumn("_trunc", F.col("_t1").startswith("<think>"))
    if truncated_as_empty:
        df = df.withColumn("_t1", F.when(F.col("_trunc"), F.lit("")).otherwise(F.col("_t1")))
    df = df.withColumn("_u", F.regexp_replace("_t1", r"^`+|`+$", ""))
    untagged = F.when(F.lower("_u").startswith("json"), strip_unicode(F.substring("_u", 5, 1 << 30))).otherwise(F.col("_u"))
    return df.withColumn("_text", F.when(F.col("_t1").startswith("```"), untagged).otherwise(F.col("_t1"))).drop(
        "_t0", "_t1", "_u")


def parse_prediction(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Strip, parse and validate a tier-3 classification response.

    Valid when the text is non-empty JSON with both labels and a routing action
    that, after L6, is one of the five literals.
    """
    cols = [c for c in df.columns if c != raw_col]
    df = staged_clean(df, raw_col, truncated_as_empty=True)
    df = df.withColumn("_p", whole_json(F.col("_text"), CLASS_FIELDS))
    text, p = F.col("_text"), F.col("_p")
    # a number or a number in quotes; any other text makes the response invalid
    conf = strip_unicode(p["confidence_score"]).try_cast("double")
    route = normalize_route(p["routing_action"], p["abstain_flag"], conf)
    df = df.withColumn("_route", route)
    route = F.col("_route")
    valid = ((text != "") & p.isNotNull() & p["predicted_category"].isNotNull()
             & p["predicted_priority"].isNotNull() & route.isin(ROUTING_ACTIONS)
             & (p["confidence_score"].isNull() | conf.isNotNull()))
    return df.select(
        *cols,
        F.coalesce(valid, F.lit(False)).alias("valid"),
        F.when(valid, p["predicted_category"]).alias("predicted_category"),
        F.when(valid, p["predicted_priority"]).alias("predicted_priority"),
        F.when(valid, conf).alias("confidence_score"),
        F.when(valid, p["abstain_flag"]).alias("abstain_flag"),
        F.when(valid, route).alias("routing_action"))


# ---- L7 / L8: answer JSON and retry selection ---------------------------------------

ANSWER_SCHEMA = "draft_response string, citations array<int>"
ANSWER_FIELDS = "draft_response: string, citations: array<int>"


def parse_answer(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Citations within {0,1,2}; text and citations both empty or both present."""
    cols = [c for c in df.columns if c != raw_col]
    df = staged_clean(df, raw_col, truncated_as_empty=False)
    df = df.withColumn("_p", whole_json(F.col("_text"), ANSWER_FIELDS))
    df = df.withColumn("_draft", strip_unicode(F.col("_p.draft_response")))
    truncated, p = F.col("_trunc"), F.col("_p")
    draft = F.col("_draft")
    cits = p["citations"]
    in_range = F.forall(cits, lambda c: c.isin(VALID_CITATIONS))
    consistent = (F.size(cits) > 0) == (draft != "")
    valid = (~truncated & p.isNotNull() & p["draft_response"].isNotNull() & cits.isNotNull()
             & in_range & consistent)
    valid = F.coalesce(valid, F.lit(False))
    return df.select(*cols, valid.alias("valid"),
                     F.when(valid, draft).alias("draft_response"),
                     F.when(valid, cits).alias("citations"))


def first_valid_attempt(parsed: DataFrame, key: str = "ticket_id", attempt_col: str = "attempt",
                        max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The first valid attempt carrying at least one citation, among the first
    ``max_attempts``; tickets without one abstain with the refusal text.

    One conditional aggregation per ticket (``min_by`` over the qualifying
    attempts): a partial aggregate, so a ticket with many attempts never gathers
    in one task; no filter, distinct or join, hence one shuffle.
    """
    ok = (F.col(attempt_col) < max_attempts) & F.col("valid") & (F.coalesce(F.size("citations"), F.lit(0)) > 0)
    order = F.when(ok, F.col(attempt_col))
    g = parsed.groupBy(key).agg(
        F.min(order).alias("chosen_attempt"),
        F.min_by(F.struct("draft_response", "citations"), order).alias("b"))
    hit = F.col("chosen_attempt").isNotNull()
    return g.select(
        key, "chosen_attempt", (~hit).alias("abstain_flag"),
        F.when(hit, F.col("b.draft_response")).otherwise(F.lit(ABSTAIN_RESPONSE_TEXT)).alias("draft_response"),
        F.when(hit, F.array_join(F.transform("b.citations", lambda c: c.cast("string")), "|"))
         .otherwise(F.lit("")).alias("citations"))


# ---- L9: query expansion ------------------------------------------------------------

def expand_queries(original: Column, hypotheticals: Column, max_queries: int = 3) -> Column:
    """Original query first, then the non-empty hypotheticals; at most three."""
    return F.slice(F.concat(F.array(strip_unicode(original)), F.filter(hypotheticals, lambda x: x != "")),
                   1, max_queries)


# ---- L10 / L11 -------------------------------------------------------------------------

def parse_verdict(text: Column) -> Column:
    """First word, surrounding punctuation stripped, equals ``relevant``."""
    first = F.element_at(F.split(strip_unicode(F.lower(F.coalesce(text, F.lit("")))), SPACE + "+"), 1)
    word = F.regexp_replace(first, r"""^[.,!?:;"'()\[\]{}]+|[.,!?:;"'()\[\]{}]+$""", "")
    return F.coalesce(word == "relevant", F.lit(False))


def classify_error(message: Column) -> Column:
    """Failed call class: rate/quota limits stop, a missing model moves on, others retry."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return (F.when(m.contains("rate") | m.contains("quota"), "rate_limited")
            .when(F.coalesce(message, F.lit("")).contains("NOT_FOUND") | m.contains("not found"), "model_not_found")
            .otherwise("other"))
