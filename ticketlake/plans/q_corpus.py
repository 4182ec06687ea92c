"""Queries for corpus preparation (D1, D4, D5) and array / split features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlake.operators import corpus as co
from ticketlake.operators import features as fe
from ticketlake.plans.common import Family, sql_str
from ticketlake.sources import logical as lg

fam = Family()


@fam.add("dedupe_within_category", lg.with_ctes(lg.TICKETS_SQL) + """
SELECT category, min(ticket_id) AS ticket_id, count(*) AS n_copies FROM tickets GROUP BY category, description""")
def q_dedupe_within_category(spark, sf):
    return co.dedupe_within_category(lg.tickets(spark, sf), "category", "description", "ticket_id")


def _sql_generalize(x: str) -> str:
    for pat, rep in co.VAGUE_SUBS:
        x = f"regexp_replace({x}, {sql_str(pat)}, {sql_str(rep)}, 'g')"
    return x


@fam.add("generalize_specifics", f"SELECT doc_id, {_sql_generalize('text')} AS text FROM documents")
def q_generalize_specifics(spark, sf):
    from ticketlake.plans.common import docs
    return docs(spark, sf).select("doc_id", co.generalize_specifics(F.col("text")).alias("text"))


def _sql_casual(x: str) -> str:
    for a, b in co.CASUAL_SUBS:
        x = f"replace({x}, {sql_str(a)}, {sql_str(b)})"
    return x


@fam.add("casual_rewrite", f"SELECT doc_id, {_sql_casual('text')} AS text FROM documents")
def q_casual_rewrite(spark, sf):
    """D5 with every pair's gate on (the draw per pair is a hash gate in general)."""
    from ticketlake.plans.common import docs
    return docs(spark, sf).select("doc_id", co.casual_rewrite(F.col("text")).alias("text"))


@fam.add("class_weights", lg.with_ctes(lg.TICKETS_SQL) + """
SELECT category, round(n / (k * n_c), 9) AS weight
FROM (SELECT category, count(*) AS n_c FROM tickets GROUP BY category),
     (SELECT count(*) AS n, count(DISTINCT category) AS k FROM tickets)""")
def q_class_weights(spark, sf):
    w = fe.class_weights(lg.tickets(spark, sf).select("ticket_id", "category"), "category")
    return w.groupBy("category").agg(F.round(F.first("weight"), 9).alias("weight"))


@fam.add("stratified_kfold", lg.with_ctes(lg.TICKETS_SQL) + f"""
SELECT ticket_id, category, CAST((row_number() OVER (PARTITION BY category ORDER BY hk, ticket_id) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT ticket_id, category, {fe.sql_mix('ticket_id', 42)} AS hk FROM tickets)""")
def q_stratified_kfold(spark, sf):
    t = lg.tickets(spark, sf).select("ticket_id", "category")
    return fe.stratified_kfold(t, "category", "ticket_id", k=5, seed=42)
