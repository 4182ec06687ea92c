"""Queries for rule labelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlake.functions import text as tx
from ticketlake.operators import rules as rl
from ticketlake.plans.common import Family, sql_str
from ticketlake.sources import logical as lg

fam = Family()

# The stand-in ticket type of each document language (so that the
# category offsets and caps of the priority rules are exercised).
LANG_TO_TYPE = {"en": "Technical issue", "fr": "Billing inquiry", "de": "Product inquiry",
                "es": "Cancellation request"}
SQL_NW = r"[^\p{L}\p{N}_]"


def sql_presence(expr: str, pattern: str) -> str:
    """Presence test with Unicode word guards in place of ``\\b`` at the ends."""
    p = pattern
    if p.startswith(r"\b"):
        p = f"(^|{SQL_NW})" + p[2:]
    if p.endswith(r"\b"):
        p = p[:-2] + f"({SQL_NW}|$)"
    return f"regexp_matches({expr}, {sql_str(p)})"


def _sql_type():
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in LANG_TO_TYPE.items())
    return f"CASE category {whens} END"


def _sql_rule_score(text: str, cat: str) -> str:
    parts = []
    for w, pats in ((3, rl.CRITICAL_PATTERNS), (2, rl.HIGH_PATTERNS), (-2, rl.LOW_PATTERNS)):
        for p in pats:
            parts.append(f"CASE WHEN {sql_presence(text, p)} THEN {w} ELSE 0 END")
    raw = " + ".join(parts)
    raw += f" - CASE WHEN length({text}) - length(replace({text}, '?', '')) >= 2 THEN 1 ELSE 0 END"
    offs = " ".join(f"WHEN {sql_str(c)} THEN {o}" for c, o in rl.CATEGORY_OFFSETS.items())
    raw = f"({raw} + CASE {cat} {offs} ELSE 0 END)"
    capped = ", ".join(sql_str(c) for c in rl.CAPPED_CATEGORIES)
    return f"CASE WHEN {cat} IN ({capped}) THEN least({raw}, 2) ELSE {raw} END"


@fam.add("assign_priority", lg.with_ctes(lg.TICKETS_SQL) + f"""
SELECT ticket_id, ticket_type, CAST(s AS INTEGER) AS priority_score,
       CASE WHEN s >= 4 THEN 'Critical' WHEN s >= 1 THEN 'High' WHEN s >= -1 THEN 'Medium' ELSE 'Low' END AS priority
FROM (SELECT ticket_id, ticket_type, {_sql_rule_score('lower(description)', 'ticket_type')} AS s
      FROM (SELECT ticket_id, description, {_sql_type()} AS ticket_type FROM tickets))""")
def q_assign_priority(spark, sf):
    t = lg.tickets(spark, sf)
    m = F.create_map(*[F.lit(x) for kv in LANG_TO_TYPE.items() for x in kv])
    t = t.select("ticket_id", "description", F.element_at(m, F.col("category")).alias("ticket_type"))
    out = rl.assign_priority(t, "description", "ticket_type")
    return out.select("ticket_id", "ticket_type", F.col("priority_score").cast("int").alias("priority_score"),
                      "priority")


@fam.add("normalize_labels", lg.with_ctes(lg.TICKETS_SQL) + """
SELECT ticket_id,
       coalesce(nullif(trim(CASE WHEN ticket_id % 6 = 0 THEN '  ' ELSE category END), ''), 'Other') AS category,
       CASE WHEN lower(trim(pr)) IN ('low', 'medium', 'high', 'critical') THEN lower(trim(pr)) ELSE 'medium' END AS priority
FROM (SELECT *, CASE WHEN ticket_id % 5 = 0 THEN ' HIGH ' WHEN ticket_id % 11 = 0 THEN 'urgent' ELSE priority END AS pr
      FROM tickets)""")
def q_normalize_labels(spark, sf):
    t = lg.tickets(spark, sf, with_priority=True)
    i = F.col("ticket_id")
    t = t.select("ticket_id",
                 F.when(i % 6 == 0, F.lit("  ")).otherwise(F.col("category")).alias("category"),
                 F.when(i % 5 == 0, F.lit(" HIGH ")).when(i % 11 == 0, F.lit("urgent"))
                 .otherwise(F.col("priority")).alias("priority"))
    return rl.normalize_labels(t, "category", "priority")


__all__ = ["fam", "tx"]
