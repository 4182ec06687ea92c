"""Queries for evaluation and cost (E1-E17) and corpus preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlake.functions import text as tx
from ticketlake.operators import evaluate as ev
from ticketlake.operators import features as fe
from ticketlake.operators import retrieval as rt
from ticketlake.plans.common import Family
from ticketlake.plans.q_retrieval import PIPE_SQL, sql_tokens
from ticketlake.session import cut_lineage
from ticketlake.sources import logical as lg
from ticketlake.sources.tables import table

fam = Family()

# ---- E1-E2 on the dense run: every vector is a query, relevant = same label ----------

DENSE_RUN_SQL = """runs AS (
  SELECT 'dense' AS run, q.vec_id AS query_id, c.vec_id AS chunk_id, q.label = c.label AS is_rel,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(
           list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) DESC, c.vec_id) - 1 AS rank
  FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id
  QUALIFY rank < 3),
pq AS (
  SELECT run, query_id,
         coalesce(1.0 / (min(CASE WHEN is_rel THEN rank END) + 1), 0.0) AS rr,
         sum(CASE WHEN is_rel THEN 1.0 / log2(rank + 2) ELSE 0.0 END) AS dcg,
         CAST(sum(CASE WHEN is_rel THEN 1 ELSE 0 END) AS BIGINT) AS n_rel
  FROM runs GROUP BY run, query_id),
pq2 AS (
  SELECT run, query_id, rr,
         CASE WHEN n_rel > 0 THEN dcg / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, n_rel + 1) t(i)) ELSE 0.0 END AS ndcg
  FROM pq)"""


def _dense_run(spark, sf):
    e = table(spark, sf, "embeddings")
    labels = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("c_label"))
    ql = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    top = rt.dense_topk(e, e.select(F.col("vec_id").alias("query_id"), "embedding"), k=3, exclude_self=True)
    return (top.join(labels, "chunk_id").join(ql, "query_id")
            .select("query_id", "chunk_id", "rank", (F.col("q_label") == F.col("c_label")).alias("is_rel")))


@fam.add("mrr_at_3", "WITH " + DENSE_RUN_SQL + """
SELECT round(avg(rr), 9) AS mrr_at_3 FROM pq2""")
def q_mrr_at_3(spark, sf):
    return ev.retrieval_metrics(_dense_run(spark, sf)).select("mrr_at_3")


@fam.add("ndcg_at_3", "WITH " + DENSE_RUN_SQL + """
SELECT round(avg(ndcg), 9) AS ndcg_at_3 FROM pq2""")
def q_ndcg_at_3(spark, sf):
    return ev.retrieval_metrics(_dense_run(spark, sf)).select("ndcg_at_3")


# ---- E3-E4: text runs against a relevance table that no run has made -----------------------

LABELS_SQL = f"""rel AS MATERIALIZED (
  SELECT query_id, chunk_id FROM (SELECT query_id, array_to_string({sql_tokens('text')}, ' ') AS q FROM bq)
  JOIN (SELECT chunk_id, array_to_string({sql_tokens('text')}, ' ') AS c FROM kb_chunks) ON q <> '' AND contains(' ' || c || ' ', ' ' || q || ' ')),
of_query AS (SELECT query_id, least(count(DISTINCT chunk_id), 3) AS n_best FROM rel GROUP BY query_id),
runs AS (
  SELECT run, r.query_id, rank, l.chunk_id IS NOT NULL AS is_rel FROM (
    SELECT 'baseline' AS run, query_id, chunk_id, rank FROM cos_top WHERE rank < 3
    UNION ALL SELECT 'improved', query_id, chunk_id, rank FROM reranked) r
  LEFT JOIN rel l ON l.query_id = r.query_id AND l.chunk_id = r.chunk_id),
pq AS (
  SELECT run, query_id, coalesce(1.0 / (min(CASE WHEN is_rel THEN rank END) + 1), 0.0) AS rr,
         sum(CASE WHEN is_rel THEN 1.0 / log2(rank + 2) ELSE 0.0 END) AS dcg, CAST(sum(CASE WHEN is_rel THEN 1 ELSE 0 END) AS BIGINT) AS n_rel
  FROM runs GROUP BY run, query_id)"""


def _text_runs(spark, sf):
    """``(run, query_id, chunk_id, rank)`` of plain cosine search and of the two-stage retrieval, and the labels."""
    from ticketlake.plans import q_retrieval as qr
    q, chunks = qr.bench_queries(spark, sf), qr.kb(spark, sf)
    index = rt.bm25_stats(chunks)
    base = rt.bow_cosine_topk(q, chunks, k=3, index=index).withColumn("run", F.lit("baseline"))
    best = rt.two_stage_retrieve(q, chunks, index=index).withColumn("run", F.lit("improved"))
    columns = ["run", "query_id", "chunk_id", "rank"]
    return base.select(*columns).unionByName(best.select(*columns)), cut_lineage(ev.containment_labels(q, chunks))


@fam.add("relevance_labels", PIPE_SQL.rstrip() + ",\n" + LABELS_SQL + " SELECT query_id, chunk_id, TRUE AS is_rel FROM rel")
def q_relevance_labels(spark, sf):
    """E3's relevance table: the chunks that hold a benchmark text."""
    from ticketlake.plans import q_retrieval as qr
    return ev.containment_labels(qr.bench_queries(spark, sf), qr.kb(spark, sf))


@fam.add("evaluate_retrieval", PIPE_SQL.rstrip() + ",\n" + LABELS_SQL + """
SELECT round(avg(rr), 9) AS mrr_at_3, round(avg(dcg / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, greatest(n_rel, n_best) + 1) t(i))), 9) AS ndcg_at_3
FROM pq JOIN of_query USING (query_id) WHERE run = 'improved'""")
def q_evaluate_retrieval(spark, sf):
    """The two-stage run against the relevance table, over the queries that have a relevant chunk."""
    runs, labels = _text_runs(spark, sf)
    relevant = labels.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("n_relevant"))
    run = runs.where("run = 'improved'").join(relevant.select("query_id"), "query_id", "left_semi")
    return ev.retrieval_metrics(ev.relevance_join(run, labels), queries=relevant, relevant=relevant)


@fam.add("compare_runs", PIPE_SQL.rstrip() + ",\n" + LABELS_SQL + """,
pq2 AS (SELECT run, rr, CASE WHEN n_rel > 0 THEN dcg / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, n_rel + 1) t(i)) ELSE 0.0 END AS ndcg FROM pq),
m AS (SELECT run, avg(rr) AS mrr, avg(ndcg) AS ndcg FROM pq2 GROUP BY run)
SELECT metric, round(b, 9) AS baseline, round(i, 9) AS improved, round(i - b, 4) AS delta FROM (
  SELECT 'mrr@3' AS metric, max(CASE WHEN run = 'baseline' THEN mrr END) AS b, max(CASE WHEN run = 'improved' THEN mrr END) AS i FROM m
  UNION ALL
  SELECT 'ndcg@3', max(CASE WHEN run = 'baseline' THEN ndcg END), max(CASE WHEN run = 'improved' THEN ndcg END) FROM m)""")
def q_compare_runs(spark, sf):
    """Plain cosine search against the two-stage retrieval, over all benchmark queries."""
    runs, labels = _text_runs(spark, sf)
    return ev.compare_runs(ev.relevance_join(runs, labels), "baseline", "improved")


# ---- E5-E8: predictions vs labels --------------------------------------------------------

LANGS = ["en", "fr", "de", "es"]
PRED_SQL = lg.with_ctes(lg.TICKETS_SQL) + f""", preds AS (
  SELECT ticket_id, category AS truth,
         CASE WHEN (ticket_id * 7919) % 10 < 7 THEN category ELSE {lg._sql_array(LANGS)}[ticket_id % 4 + 1] END AS pred,
         CAST((ticket_id * 104729) % 1000 AS DOUBLE) / 1000.0 AS conf
  FROM tickets)"""


def _preds(spark, sf):
    t = lg.tickets(spark, sf)
    i = F.col("ticket_id")
    pred = F.when((i * 7919) % 10 < 7, F.col("category")).otherwise(lg.pick(LANGS, i % 4))
    return t.select("ticket_id", F.col("category").alias("truth"), pred.alias("pred"),
                    lg.permille(i * 104729).alias("conf"))


REPORT_SQL = PRED_SQL + """, cm AS (SELECT truth, pred, count(*) AS n FROM preds GROUP BY ALL),
labs AS (SELECT truth AS label FROM cm UNION SELECT pred FROM cm),
per AS (
  SELECT l.label,
         coalesce((SELECT sum(n) FROM cm WHERE truth = l.label AND pred = l.label), 0) AS tp,
         coalesce((SELECT sum(n) FROM cm WHERE truth = l.label), 0) AS support,
         coalesce((SELECT sum(n) FROM cm WHERE pred = l.label), 0) AS n_pred
  FROM labs l),
per2 AS (
  SELECT label, tp, support,
         CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
per3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per2),
rep AS (
  SELECT label, precision, recall, f1, CAST(support AS BIGINT) AS support FROM per3
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM per3
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per3
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per3)"""


@fam.add("classification_report", REPORT_SQL + """
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM rep""")
def q_classification_report(spark, sf):
    return ev.classification_report(_preds(spark, sf), "truth", "pred")


@fam.add("macro_f1", REPORT_SQL + """
SELECT round(max(CASE WHEN label = 'macro avg' THEN f1 END), 9) AS macro_f1,
       round(max(CASE WHEN label = 'accuracy' THEN f1 END), 9) AS accuracy FROM rep""")
def q_macro_f1(spark, sf):
    return ev.macro_f1(_preds(spark, sf), "truth", "pred")


BINS_SQL = PRED_SQL + """, b0 AS (SELECT *, CAST(ceil(conf * 10) AS INTEGER) - 1 AS b0, truth = pred AS ok FROM preds),
b1 AS (SELECT *, CASE WHEN conf > 0 THEN least(CASE WHEN conf <= b0 * CAST(0.1 AS DOUBLE) THEN b0 - 1 WHEN conf > (b0 + 1) * CAST(0.1 AS DOUBLE) THEN b0 + 1 ELSE b0 END, 9) END AS bin FROM b0),
g AS (SELECT bin, count(*) AS n, avg(conf) AS mean_conf, avg(CAST(ok AS DOUBLE)) AS accuracy FROM b1 WHERE bin IS NOT NULL GROUP BY bin),
tot AS (SELECT count(*) AS n_all FROM preds)"""


@fam.add("reliability_bins", BINS_SQL + """
SELECT CAST(bin AS INTEGER) AS bin, n, round(mean_conf, 9) AS mean_conf, round(accuracy, 9) AS accuracy,
       round(n / n_all, 9) AS share FROM g, tot""")
def q_reliability_bins(spark, sf):
    p = _preds(spark, sf).withColumn("ok", F.col("truth") == F.col("pred"))
    return ev.reliability_bins(p, "conf", "ok")


@fam.add("ece", BINS_SQL + """
SELECT round(coalesce(sum(abs(accuracy - mean_conf) * n / n_all), 0.0), 9) AS ece FROM g, tot""")
def q_ece(spark, sf):
    p = _preds(spark, sf).withColumn("ok", F.col("truth") == F.col("pred"))
    return ev.ece(p, "conf", "ok")


# ---- E9-E10: answers ------------------------------------------------------------------------

def _answers(spark, sf):
    from ticketlake.operators import completions as cp
    return cp.first_valid_attempt(cp.parse_answer(lg.answer_completions(spark, sf)))


def _answer_sql():
    from ticketlake.plans.q_completions import _answer_parsed_sql
    from ticketlake.plans.common import sql_str
    from ticketlake.operators.completions import ABSTAIN_RESPONSE_TEXT
    return _answer_parsed_sql() + f""",
best AS (
  SELECT ticket_id, attempt, draft, cits FROM v WHERE attempt < 3 AND valid AND len(cits) > 0
  QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY attempt) = 1),
ans AS (
  SELECT t.ticket_id, b.attempt IS NULL AS abstain_flag,
         coalesce(b.draft, {sql_str(ABSTAIN_RESPONSE_TEXT)}) AS draft_response
  FROM (SELECT DISTINCT ticket_id FROM v) t LEFT JOIN best b ON t.ticket_id = b.ticket_id)"""


@fam.add("answer_eval_set", _answer_sql() + """,
ctx AS (SELECT conv_id AS ticket_id, list(text ORDER BY turn, text) AS contexts FROM conversations WHERE turn >= 1 GROUP BY conv_id)
SELECT a.ticket_id, a.draft_response AS answer, coalesce(c.contexts, []::VARCHAR[]) AS contexts
FROM ans a LEFT JOIN ctx c USING (ticket_id)
WHERE NOT a.abstain_flag AND trim(coalesce(a.draft_response, '')) <> ''""")
def q_answer_eval_set(spark, sf):
    cv = table(spark, sf, "conversations").where(F.col("turn") >= 1)
    ctx = cv.select(F.col("conv_id").alias("ticket_id"), F.col("turn").alias("rank"), "text")
    return ev.answer_eval_set(_answers(spark, sf), ctx, k=None)


@fam.add("answer_eval_summary", _answer_sql() + """,
ok AS (SELECT ticket_id FROM ans WHERE NOT abstain_flag AND trim(coalesce(draft_response, '')) <> ''),
m AS (SELECT ticket_id, CAST((ticket_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS faithfulness,
             CAST((ticket_id * 104729) % 1000 AS DOUBLE) / 1000.0 AS answer_relevancy,
             CAST((ticket_id * 7907) % 1000 AS DOUBLE) / 1000.0 AS context_precision
      FROM (SELECT DISTINCT conv_id AS ticket_id FROM conversations))
SELECT (SELECT CAST(count(*) AS BIGINT) FROM ok) AS n_evaluated,
       (SELECT CAST(count(*) AS BIGINT) FROM ans WHERE abstain_flag) AS n_abstained,
       round(coalesce(avg(m.faithfulness), 0.0), 9) AS faithfulness,
       round(coalesce(avg(m.answer_relevancy), 0.0), 9) AS answer_relevancy,
       round(coalesce(avg(m.context_precision), 0.0), 9) AS context_precision
FROM ok JOIN m USING (ticket_id)""")
def q_answer_eval_summary(spark, sf):
    cv = table(spark, sf, "conversations").select(F.col("conv_id").alias("ticket_id")).distinct()
    i = F.col("ticket_id")
    metrics = cv.select("ticket_id", lg.permille(i * 7919).alias("faithfulness"),
                        lg.permille(i * 104729).alias("answer_relevancy"), lg.permille(i * 7907).alias("context_precision"))
    return ev.answer_eval_summary(_answers(spark, sf), metrics, ["faithfulness", "answer_relevancy", "context_precision"])


# ---- E11-E15: cost ----------------------------------------------------------------------------

COST_SQL = lg.with_ctes(lg.USAGE_SQL) + """, uc AS (
  SELECT *, CAST(input_tokens AS DOUBLE) / 1000.0 * 0.00025 + CAST(output_tokens AS DOUBLE) / 1000.0 * 0.00125 AS cost_usd
  FROM usage)"""

COST_AGGS = """CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
       round(sum(cost_usd), 12) AS total_cost_usd, count(*) AS call_count"""


@fam.add("usage_cost", COST_SQL + "SELECT call_id, component, input_tokens, output_tokens, ticket_id, cost_usd FROM uc")
def q_usage_cost(spark, sf):
    return ev.usage_cost(lg.usage(spark, sf)).select("call_id", "component", "input_tokens", "output_tokens",
                                                     "ticket_id", "cost_usd")


@fam.add("cost_by_component", COST_SQL + f"SELECT component, {COST_AGGS} FROM uc GROUP BY component")
def q_cost_by_component(spark, sf):
    return ev.cost_by_component(lg.usage(spark, sf))


@fam.add("cost_totals", COST_SQL + """
SELECT CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_input_tokens,
       CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output_tokens,
       coalesce(round(sum(cost_usd), 12), 0) AS total_cost_usd, count(*) AS total_calls FROM uc""")
def q_cost_totals(spark, sf):
    return ev.cost_totals(lg.usage(spark, sf))


@fam.add("cost_by_ticket", COST_SQL + f"SELECT ticket_id, {COST_AGGS} FROM uc WHERE ticket_id IS NOT NULL GROUP BY ticket_id")
def q_cost_by_ticket(spark, sf):
    return ev.cost_by_ticket(lg.usage(spark, sf))


@fam.add("avg_cost_per_call", COST_SQL + """
SELECT round(coalesce(sum(cost_usd), 0.0) / greatest(count(*), 1), 15) AS avg_cost_per_call,
       (SELECT round(coalesce(avg(t), 0.0), 15) FROM (SELECT sum(cost_usd) AS t FROM uc WHERE ticket_id IS NOT NULL GROUP BY ticket_id))
         AS avg_cost_per_ticket
FROM uc""")
def q_avg_cost_per_call(spark, sf):
    return ev.avg_cost_per_call(lg.usage(spark, sf))


# ---- E16-E17 ------------------------------------------------------------------------------------

SPLIT_SQL = lg.with_ctes(lg.TICKETS_SQL) + f""", h AS (
  SELECT ticket_id, category, {fe.sql_mix('ticket_id', 42)} AS hk FROM tickets),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY hk, ticket_id) - 1 AS rk,
             count(*) OVER (PARTITION BY category) AS n FROM h),
split AS (SELECT ticket_id, category,
                 CASE WHEN rk < floor(n * 0.6) THEN 'train' WHEN rk < floor(n * 0.8) THEN 'val' ELSE 'test' END AS split
          FROM r)"""


@fam.add("stratified_split", SPLIT_SQL + "SELECT ticket_id, category, split FROM split")
def q_stratified_split(spark, sf):
    t = lg.tickets(spark, sf).select("ticket_id", "category")
    return fe.stratified_split(t, "category", "ticket_id", seed=42).select("ticket_id", "category", "split")


@fam.add("label_distribution", SPLIT_SQL + """, g AS (SELECT split, category, count(*) AS n FROM split GROUP BY ALL),
t AS (SELECT split, count(*) AS total FROM split GROUP BY split)
SELECT split, category, n, (n * 2000 + total) // (2 * total) / 1000.0 AS share FROM g JOIN t USING (split)""")
def q_label_distribution(spark, sf):
    t = lg.tickets(spark, sf).select("ticket_id", "category")
    s = fe.stratified_split(t, "category", "ticket_id", seed=42)
    return ev.label_distribution(s, "category", "split")


@fam.add("corpus_quality", lg.with_ctes(lg.TICKETS_SQL) + f"""
SELECT n, n_unique, round((n - n_unique) / n * 100, 9) AS dupe_pct, avg_words, n_short FROM (
  SELECT count(*) AS n, count(DISTINCT description) AS n_unique,
         round(avg(len(list_filter(string_split_regex(description, '{tx.SPACE}+'), lambda w: w <> ''))), 9) AS avg_words,
         count(*) FILTER (WHERE len(list_filter(string_split_regex(description, '{tx.SPACE}+'), lambda w: w <> '')) < 10) AS n_short
  FROM tickets)""")
def q_corpus_quality(spark, sf):
    return ev.corpus_quality(lg.tickets(spark, sf), "description")
