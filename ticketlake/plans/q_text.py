"""Queries for scans (S) and privacy / text normalisation (P)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ticketlake.functions import text as tx
from ticketlake.operators import scrub as sc
from ticketlake.plans.common import Family, docs, sql_case_map, sql_str
from ticketlake.session import checkpoint_dir
from ticketlake.sources import logical as lg
from ticketlake.sources import tables as tb

fam = Family()

# The gazetteer and lemma dictionary the registered queries run with.
GAZETTEER = {
    "PERSON": ["Eriner", "Anon"],
    "ORG": ["Orre", "Ofonrereer"],
    "GPE": ["Nicht Sich"],
    "LOC": ["Dans"],
}
LEMMAS = {
    "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "has": "have",
    "had": "have", "does": "do", "did": "do", "tickets": "ticket", "charges": "charge",
    "charged": "charge", "refunds": "refund", "issues": "issue", "errors": "error",
}


def lemma_map_col():
    return F.create_map(*[F.lit(x) for kv in LEMMAS.items() for x in kv])


# Files that a trigger of the streaming scrub takes.
STREAM_FILES = 4

# ---- SQL building blocks (DuckDB dialect) -------------------------------------

def sql_redact(expr: str, label: str) -> str:
    return (f"regexp_replace({expr}, {sql_str(tx.PII_PATTERN[label])}, "
            f"{sql_str(tx.REDACTION_TAGS[label])}, 'g')")


def sql_scrub_regex(expr: str) -> str:
    for label, _ in tx.PII_PATTERNS:
        expr = sql_redact(expr, label)
    return expr


def sql_entities(expr: str) -> str:
    for label in ("PERSON", "ORG", "GPE", "LOC"):
        names = GAZETTEER.get(label)
        if names:
            # RE2's \\b is ASCII only: the borders are spelled out, and a second pass takes the
            # matches whose border the one before has used up
            inner = sc.entity_pattern(names).removeprefix(r"\b").removesuffix(r"\b")
            pat = sql_str(r"(^|[^\p{L}\p{N}_])" + inner + r"([^\p{L}\p{N}_]|$)")
            for _ in range(2):
                expr = f"regexp_replace({expr}, {pat}, {sql_str(chr(92) + '1' + tx.REDACTION_TAGS[label] + chr(92) + '2')}, 'g')"
    return expr


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{tx.SPACE}+|{tx.SPACE}+$', '', 'g')"


def sql_normalize_text(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '[^\\p{{L}}\\p{{N}}_{tx.SPACE_CHARS}]', ' ', 'g')"


def sql_unescape_basic(expr: str) -> str:
    # The documents carry no entity references; the oracle decodes the basic five.
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        expr = f"replace({expr}, {sql_str(ent)}, {sql_str(ch)})"
    return expr


def sql_lemmatize(expr: str) -> str:
    return ("array_to_string(list_transform(list_filter(string_split_regex("
            f"{sql_strip(expr)}, '{tx.SPACE}+'), lambda w: w <> ''), lambda w: {sql_case_map('w', LEMMAS)}), ' ')")


def sql_normalize_full(expr: str) -> str:
    return sql_lemmatize(sql_normalize_text(sql_unescape_basic(expr)))


def sql_normalize_ticket_text(expr: str) -> str:
    t = sql_strip(f"lower({expr})")
    t = f"regexp_replace({t}, '\\{{[^{{}}]+\\}}', ' ', 'g')"
    t = f"regexp_replace({t}, '{tx.SPACE}+', ' ', 'g')"
    return sql_strip(t)


# ---- S: scans ---------------------------------------------------------------------

def _scratch(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@fam.add("scan_tickets", lg.with_ctes(lg.TICKETS_SQL) + """
SELECT CAST(ticket_id AS VARCHAR) AS "Ticket ID", description AS "Ticket Description",
       category AS "Ticket Type", priority AS "Ticket Priority" FROM tickets""")
def q_scan_tickets(spark, sf):
    """Tickets written as a quoted, multi-line CSV with a header, scanned back
    with an explicit schema (no inference)."""
    from pyspark.sql import types as T
    path = _scratch(spark, "tickets-csv")
    (lg.tickets(spark, sf, with_priority=True)
     .select(F.col("ticket_id").cast("string").alias("Ticket ID"),
             F.col("description").alias("Ticket Description"),
             F.col("category").alias("Ticket Type"), F.col("priority").alias("Ticket Priority"))
     .write.option("header", True).option("escape", '"').csv(path))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in
                           ("Ticket ID", "Ticket Description", "Ticket Type", "Ticket Priority")])
    return tb.scan_ticket_csv(spark, path, schema)


@fam.add("resolve_ticket_fields", lg.with_ctes(lg.TICKETS_SQL) + """
SELECT coalesce(nullif(trim(CASE WHEN ticket_id % 10 = 0 THEN NULL ELSE CAST(ticket_id AS VARCHAR) END), ''),
                nullif(trim('T-' || CAST(ticket_id AS VARCHAR)), ''), '') AS ticket_id,
       coalesce(nullif(trim(CASE WHEN ticket_id % 3 = 0 THEN '' ELSE category END), ''), '') AS subject,
       coalesce(nullif(trim(CASE WHEN ticket_id % 4 = 0 THEN NULL ELSE description END), ''),
                nullif(trim(description), ''), '') AS message
FROM tickets""")
def q_resolve_ticket_fields(spark, sf):
    """Id / subject / message from alternative column names, first non-empty wins."""
    from ticketlake.operators.sources_ops import resolve_ticket_fields
    t = lg.tickets(spark, sf)
    i = F.col("ticket_id")
    raw = t.select(
        F.when(i % 10 == 0, F.lit(None)).otherwise(i.cast("string")).alias("ticket_id"),
        F.concat(F.lit("T-"), i.cast("string")).alias("Ticket ID"),
        F.when(i % 3 == 0, F.lit("")).otherwise(F.col("category")).alias("subject"),
        F.when(i % 4 == 0, F.lit(None)).otherwise(F.col("description")).alias("message"),
        F.col("description").alias("Ticket Description"))
    return resolve_ticket_fields(raw)


@fam.add("synth_ticket_id", lg.with_ctes(lg.TICKETS_SQL) + """
SELECT coalesce(CASE WHEN ticket_id % 6 = 0 THEN NULL ELSE 'ticket_' || CAST(ticket_id AS VARCHAR) END,
                'row_' || CAST(row_number() OVER (ORDER BY ticket_id) AS VARCHAR)) AS ticket_id,
       category FROM tickets""")
def q_synth_ticket_id(spark, sf):
    """S3: rows without an id get ``row_{n}`` (1-based, in the stated key order)."""
    from ticketlake.operators.sources_ops import synth_ticket_id
    t = lg.tickets(spark, sf)
    i = F.col("ticket_id")
    raw = t.select(F.when(i % 6 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("ticket_"), i.cast("string"))).alias("tid"), i.alias("ord"), "category")
    return synth_ticket_id(raw, id_col="tid", order_col="ord").select(
        F.col("tid").alias("ticket_id"), "category")


@fam.add("scan_kb_docs", "SELECT doc_id, text FROM documents")
def q_scan_kb_docs(spark, sf):
    """Documents in text files, many to a file."""
    path = _scratch(spark, "kb-text")
    tb.write_kb_pack(docs(spark, sf), path)
    return tb.scan_kb_pack(spark, path).select("doc_id", "text")


# ---- P: privacy -------------------------------------------------------------------

def _redact_query(label: str):
    def q(spark, sf):
        return docs(spark, sf).select("doc_id", tx.redact(F.col("text"), label).alias("text"))
    q.__doc__ = f"Redact {label} in every document."
    return q


for _name, _label in (("redact_email", "EMAIL"), ("redact_phone", "PHONE"), ("redact_ssn", "SSN"),
                      ("redact_zip", "ZIP"), ("redact_ip", "IP"), ("redact_card", "CREDIT_CARD")):
    fam.add(_name, f"SELECT doc_id, {sql_redact('text', _label)} AS text FROM documents")(
        _redact_query(_label))


@fam.add("scrub_text", f"SELECT doc_id, {sql_scrub_regex('text')} AS text FROM documents")
def q_scrub_text(spark, sf):
    return docs(spark, sf).select("doc_id", tx.scrub_regex(F.col("text")).alias("text"))


@fam.add("redact_entities", f"SELECT doc_id, {sql_entities('text')} AS text FROM documents")
def q_redact_entities(spark, sf):
    return docs(spark, sf).select("doc_id", sc.redact_entities(F.col("text"), GAZETTEER).alias("text"))


def _names(spark, sf):
    """A gazetteer that grows with the data: the fixed names, and all customers and suppliers as organisations."""
    own = sc.gazetteer_table(spark, GAZETTEER)
    for name, col in (("customer", "c_name"), ("supplier", "s_name")):
        own = own.unionByName(tb.table(spark, sf, name).select(F.lit("ORG").alias("label"), F.col(col).alias("name")))
    return own


@fam.add("redact_entities_table", f"SELECT doc_id, {sql_entities('text')} AS text FROM documents")
def q_redact_entities_table(spark, sf):
    """P8 by a join with a table of names (no customer or supplier is named in the documents)."""
    return sc.redact_entities_table(docs(spark, sf).select("doc_id", "text"), "text", _names(spark, sf))


@fam.add("scrub_full", f"SELECT doc_id, {sql_entities(sql_scrub_regex('text'))} AS text FROM documents")
def q_scrub_full(spark, sf):
    return docs(spark, sf).select("doc_id", sc.scrub_full(F.col("text"), GAZETTEER).alias("text"))


@fam.add("mask_columns", """
SELECT doc_id, CASE WHEN src IS NOT NULL THEN '[REDACTED_ORG]' END AS source, lang
FROM (SELECT doc_id, lang, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source END AS src FROM documents)""")
def q_mask_columns(spark, sf):
    d = docs(spark, sf).select(
        "doc_id", "lang", F.when(F.col("doc_id") % 9 == 0, F.lit(None)).otherwise(F.col("source")).alias("source"))
    return sc.mask_columns(d, {"source": "[REDACTED_ORG]"}).select("doc_id", "source", "lang")


def _sql_hits():
    cur = "text"
    parts = []
    for label, pat in tx.PII_PATTERNS:
        parts.append(f"len(regexp_extract_all({cur}, {sql_str(pat)}))")
        cur = sql_redact(cur, label)
    return " + ".join(parts)


def _sql_ner_hits():
    """Tags after the entities are redacted, less those before: a tag is no name and is never matched."""
    tags = [tx.REDACTION_TAGS[label] for label in ("PERSON", "ORG", "GPE", "LOC") if GAZETTEER.get(label)]

    def count(expr):
        return " + ".join(f"(len({expr}) - len(replace({expr}, {sql_str(t)}, ''))) / {len(t)}" for t in dict.fromkeys(tags))
    return f"({count(sql_entities(sql_scrub_regex('text')))}) - ({count(sql_scrub_regex('text'))})"


@fam.add("scrub_stats", f"""
SELECT CAST(sum({_sql_hits()}) AS BIGINT) AS regex_matches,
       CAST(sum({_sql_ner_hits()}) AS BIGINT) AS ner_matches,
       CAST(sum(CASE WHEN text IS NOT NULL AND {sql_normalize_full(sql_entities(sql_scrub_regex('text')))} <> text
                     THEN 1 ELSE 0 END) AS BIGINT) AS cells_changed
FROM documents""")
def q_scrub_stats(spark, sf):
    return sc.scrub_stats(docs(spark, sf), ["text"], masks={}, gazetteer=GAZETTEER,
                          lemma_map=lemma_map_col())


@fam.add("html_unescape")
def q_html_unescape(spark, sf):
    """P12 over raw pages; checked against Python's html.unescape in the tests."""
    p = tb.table(spark, sf, "pages")
    return p.select("page_id", tx.html_unescape(F.col("html")).alias("text"))


@fam.add("normalize_text", f"SELECT doc_id, {sql_normalize_text('text')} AS text FROM documents")
def q_normalize_text(spark, sf):
    return docs(spark, sf).select("doc_id", tx.normalize_text(F.col("text")).alias("text"))


@fam.add("lemmatize", f"SELECT doc_id, {sql_lemmatize(sql_normalize_text('text'))} AS text FROM documents")
def q_lemmatize(spark, sf):
    return docs(spark, sf).select(
        "doc_id", tx.lemmatize(tx.normalize_text(F.col("text")), lemma_map_col()).alias("text"))


@fam.add("lemmatize_table", f"""
WITH w AS (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM (
  SELECT doc_id, list_filter(string_split_regex({sql_strip(sql_normalize_text('text'))}, '{tx.SPACE}+'), lambda x: x <> '') AS ws FROM documents)),
l AS (SELECT DISTINCT r_name, lower(r_name) AS word FROM region),
t AS (SELECT doc_id, string_agg(coalesce('<' || r_name || '>', {sql_case_map('w.word', LEMMAS)}), ' ' ORDER BY pos) AS text
      FROM w LEFT JOIN l ON l.word = w.word GROUP BY doc_id)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text FROM documents d LEFT JOIN t USING (doc_id)""")
def q_lemmatize_table(spark, sf):
    """P14 by a join with a dictionary table: the fixed lemmas, and the regions' names as lemmas of themselves."""
    fixed = spark.createDataFrame(list(LEMMAS.items()), "word string, lemma string")
    regions = tb.table(spark, sf, "region").select(F.col("r_name").alias("word"), F.concat(F.lit("<"), F.col("r_name"), F.lit(">")).alias("lemma"))
    d = docs(spark, sf).select("doc_id", tx.normalize_text(F.col("text")).alias("text"))
    return sc.lemmatize_join(d, "text", fixed.unionByName(regions), "lemmas").select("doc_id", F.col("lemmas").alias("text"))


@fam.add("normalize_ticket_text", f"""
SELECT doc_id, {sql_normalize_ticket_text("CASE WHEN doc_id % 5 = 0 THEN '{order_id} ' || text || ' {name}' ELSE text END")} AS text
FROM documents""")
def q_normalize_ticket_text(spark, sf):
    d = docs(spark, sf)
    t = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("{order_id} "), F.col("text"), F.lit(" {name}"))
               ).otherwise(F.col("text"))
    return d.select("doc_id", tx.normalize_ticket_text(t).alias("text"))


@fam.add("compose_text", lg.with_ctes(lg.TICKETS_SQL) + f"""
SELECT ticket_id, {sql_normalize_ticket_text(sql_strip("lower(coalesce(CASE WHEN ticket_id % 7 = 0 THEN NULL ELSE description END, ''))"))} AS model_text
FROM tickets""")
def q_compose_text(spark, sf):
    t = lg.tickets(spark, sf)
    desc = F.when(F.col("ticket_id") % 7 == 0, F.lit(None)).otherwise(F.col("description"))
    return t.select("ticket_id", tx.compose_text(desc).alias("model_text"))


_AGE_SPARK = None
AGE_SQL = """CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'n/a'
  WHEN 2 THEN CAST(doc_id % 90 AS VARCHAR) WHEN 3 THEN CAST(doc_id % 90 AS VARCHAR) || '.9'
  WHEN 4 THEN '-' || CAST(doc_id % 10 AS VARCHAR) WHEN 5 THEN ' ' || CAST(doc_id % 70 AS VARCHAR) || ' '
  ELSE 'about ' || CAST(doc_id % 60 AS VARCHAR) END"""


def _age_raw():
    i = F.col("doc_id")
    k = i % 7
    return (F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "n/a")
            .when(k == 2, (i % 90).cast("string"))
            .when(k == 3, F.concat((i % 90).cast("string"), F.lit(".9")))
            .when(k == 4, F.concat(F.lit("-"), (i % 10).cast("string")))
            .when(k == 5, F.concat(F.lit(" "), (i % 70).cast("string"), F.lit(" ")))
            .otherwise(F.concat(F.lit("about "), (i % 60).cast("string"))))


@fam.add("age_bucket", f"""
SELECT doc_id, CASE WHEN age IS NULL THEN NULL
                    WHEN TRY_CAST(age AS DOUBLE) IS NULL OR isnan(TRY_CAST(age AS DOUBLE)) THEN age
                    ELSE CAST(CAST(floor(trunc(TRY_CAST(age AS DOUBLE)) / 5.0) * 5 AS BIGINT) AS VARCHAR) || '-' ||
                         CAST(CAST(floor(trunc(TRY_CAST(age AS DOUBLE)) / 5.0) * 5 + 5 AS BIGINT) AS VARCHAR) END AS age
FROM (SELECT doc_id, {AGE_SQL} AS age FROM documents)""")
def q_age_bucket(spark, sf):
    return docs(spark, sf).select("doc_id", tx.age_bucket(_age_raw()).alias("age"))


@fam.add("drop_id", lg.with_ctes(lg.TICKETS_SQL) + "SELECT description, category, priority FROM tickets")
def q_drop_id(spark, sf):
    return sc.scrub_table(lg.tickets(spark, sf, with_priority=True), text_columns=[], masks={}, drop_id="ticket_id",
                          age_column=None)


@fam.add("scrub_table", lg.with_ctes(lg.TICKETS_SQL) + f"""
SELECT ticket_id,
       CASE WHEN description IS NULL THEN NULL
            ELSE {sql_normalize_full(sql_entities(sql_scrub_regex('description')))} END AS description,
       category, priority
FROM tickets""")
def q_scrub_table(spark, sf):
    """Scrubbed first, so that no expression runs on the far side of the join with the labels."""
    return lg.join_priority(spark, sf, sc.scrub_table(lg.tickets(spark, sf), text_columns=["description"], masks={},
                                                      gazetteer=GAZETTEER, lemma_map=lemma_map_col(), age_column=None))


@fam.add("scrub_table_stream", f"""
SELECT doc_id AS ticket_id,
       CASE WHEN text IS NULL THEN NULL ELSE {sql_normalize_full(sql_entities(sql_scrub_regex('text')))} END AS description
FROM documents""")
def q_scrub_table_stream(spark, sf):
    """P19 as a stream over the tickets' files, some in each trigger."""
    from ticketlake.streaming import streams as st
    source = st.stage_as_stream_source(lg.tickets(spark, sf).select("ticket_id", "description"), "tickets")
    arriving = (spark.readStream.schema("ticket_id long, description string").option("maxFilesPerTrigger", STREAM_FILES)
                .parquet(source))
    return st.scrub_stream(arriving, _scratch(spark, "scrub-stream"), text_columns=["description"], masks={},
                           gazetteer=GAZETTEER, lemma_map=lemma_map_col(), age_column=None)


@fam.add("tokenize", """
SELECT doc_id, len(toks) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS toks FROM documents)""")
def q_tokenize(spark, sf):
    toks = tx.tokenize(F.col("text"))
    return docs(spark, sf).select("doc_id", F.size(toks).cast("long").alias("n_tokens"),
                                  F.array_join(toks, " ").alias("tokens"))
