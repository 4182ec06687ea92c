"""Queries for text features, keyword mining, calibration and heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlake.operators import calibrate as ca
from ticketlake.operators import evaluate as ev
from ticketlake.operators import features as fe
from ticketlake.operators import rules as rl
from ticketlake.operators import term_blocks as tb
from ticketlake.plans.common import Family, docs
from ticketlake.plans.q_eval import COST_SQL
from ticketlake.plans.q_text import sql_normalize_ticket_text
from ticketlake.session import stored
from ticketlake.sources import logical as lg
from ticketlake.sources.tables import table

fam = Family()

# Document-frequency bounds and sizes of the pruned vocabularies, keywords of a class.
MIN_DF, MAX_DF, WORD_FEATURES, CHAR_FEATURES, TOP_KEYWORDS = 2, 0.95, 20_000, 10_000, 10

# A text's tokens or characters stand in a column of their own, so that grams do not take it apart again.
WORDS_SQL = """words_of AS MATERIALIZED (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'),
  lambda t: length(t) >= 2) AS x FROM documents)"""
CHARS_SQL = "chars_of AS MATERIALIZED (SELECT doc_id AS id, regexp_extract_all(lower(text), '(?s).') AS x FROM documents)"
WORD_GRAMS = "list_concat(x, list_transform(range(1, greatest(len(x), 1)), lambda i: x[i] || ' ' || x[i + 1]))"
CHAR_GRAMS = "list_concat(list_concat({}, {}), {})".format(*[
    f"list_transform(range(1, greatest(len(x) - {n} + 2, 1)), lambda i: {' || '.join(f'x[i + {k}]' for k in range(n))})" for n in (3, 4, 5)])


def _tfidf_sql(name: str, src: str, grams: str, sublinear: bool, min_df: int, max_df: float, top: int | None = None) -> str:
    tf = "1.0 + ln(tf)" if sublinear else "tf"
    keep = f"QUALIFY row_number() OVER (ORDER BY cf DESC, term) <= {top}" if top else ""
    return f"""{name}_f AS MATERIALIZED (SELECT id, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT id, unnest({grams}) AS term FROM {src}) GROUP BY ALL),
{name}_n AS (SELECT count(*) AS n FROM {src}),
{name}_v AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf FROM (
  SELECT term, count(*) AS df, sum(tf) AS cf FROM {name}_f GROUP BY term), {name}_n
  WHERE df >= {min_df} AND df <= n * {max_df} {keep}),
{name}_w AS (SELECT id, term, ({tf}) * idf AS w FROM {name}_f JOIN {name}_v USING (term)),
{name} AS MATERIALIZED (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM {name}_w)"""


WORD_SQL = f"WITH {WORDS_SQL}, " + _tfidf_sql("word", "words_of", WORD_GRAMS, False, 1, 1.0)
PRUNED_WORD_SQL = f"{WORDS_SQL}, " + _tfidf_sql("words", "words_of", WORD_GRAMS, True, MIN_DF, MAX_DF, WORD_FEATURES)
PRUNED_CHAR_SQL = f"{CHARS_SQL}, " + _tfidf_sql("chars", "chars_of", CHAR_GRAMS, True, MIN_DF, MAX_DF, CHAR_FEATURES)


def _vector_sql(src: str) -> str:
    return f"SELECT id, list(term ORDER BY term) AS terms, list(round(weight, 6) ORDER BY term) AS weights FROM {src} GROUP BY id"


PLACES = 6  # of the weights


def _pruned(spark, sf, grams, features):
    return fe.tfidf_vectors(docs(spark, sf), "doc_id", grams(F.col("text")), True, MIN_DF, MAX_DF, features, places=PLACES)


@fam.add("tfidf_word", WORD_SQL + _vector_sql("word"))
def q_tfidf_word(spark, sf):
    """word 1- and 2-grams of all documents."""
    return fe.tfidf_vectors(docs(spark, sf), "doc_id", tb.word_grams(F.col("text")), places=PLACES)


@fam.add("tfidf_char", f"WITH {PRUNED_CHAR_SQL} " + _vector_sql("chars"))
def q_tfidf_char(spark, sf):
    """character 3- to 5-grams of all documents."""
    return _pruned(spark, sf, tb.char_grams, CHAR_FEATURES)


@fam.add("tfidf_union", f"WITH {PRUNED_WORD_SQL}, {PRUNED_CHAR_SQL}, both_blocks AS (\n  "
         "SELECT id, 'word:' || term AS term, weight FROM words UNION ALL SELECT id, 'char:' || term, weight FROM chars) "
         + _vector_sql("both_blocks"))
def q_tfidf_union(spark, sf):
    """both blocks side by side."""
    d, t = docs(spark, sf), F.col("text")
    return fe.tfidf_union(fe.pruned(d, "doc_id", tb.word_grams(t), "word", MIN_DF, MAX_DF, WORD_FEATURES),
                          fe.pruned(d, "doc_id", tb.char_grams(t), "char", MIN_DF, MAX_DF, CHAR_FEATURES), places=PLACES)


@fam.add("tfidf_pruned", f"WITH {PRUNED_WORD_SQL} " + _vector_sql("words"))
def q_tfidf_pruned(spark, sf):
    """the most frequent words and pairs only, counts taken as 1 + ln."""
    return _pruned(spark, sf, tb.word_grams, WORD_FEATURES)


KEYWORDS_SQL = WORD_SQL + f""", m AS MATERIALIZED (
  SELECT lang AS class, term, sum(weight) / any_value(n_c) AS mean FROM word JOIN documents ON doc_id = id
  JOIN (SELECT lang, count(*) AS n_c FROM documents GROUP BY lang) USING (lang) GROUP BY ALL),
t2 AS (SELECT term, max(mean) AS m1, arg_max(class, mean) AS c1, coalesce(max(mean, 2)[2], 0.0) AS m2 FROM m GROUP BY term),
s AS (SELECT class, term, mean, round(mean - CASE WHEN class = c1 THEN m2 ELSE m1 END, 9) AS specificity FROM m JOIN t2 USING (term)),
kw AS MATERIALIZED (SELECT class, CAST(row_number() OVER (PARTITION BY class ORDER BY specificity DESC, term DESC) AS INTEGER) AS rank, term AS ngram,
  specificity FROM s WHERE mean > 0 AND specificity > 0 QUALIFY rank <= {TOP_KEYWORDS})"""


def _keywords(spark, sf):
    marked = docs(spark, sf).select(F.col("lang").alias("category"), "text")
    return rl.text_keywords(marked, "category", tb.word_grams(F.col("text")), TOP_KEYWORDS)


@fam.add("class_keywords", KEYWORDS_SQL + " SELECT class, rank, ngram, round(specificity, 6) AS specificity FROM kw")
def q_class_keywords(spark, sf):
    """R2: the terms that tell a class from every other."""
    return _keywords(spark, sf).select("class", "rank", "ngram", F.round("specificity", 6).alias("specificity"))


@fam.add("keyword_rule_predict", KEYWORDS_SQL + f""",
tx AS MATERIALIZED (SELECT doc_id AS ticket_id, {sql_normalize_ticket_text('text')} AS t FROM documents),
hit AS (SELECT ticket_id, class, count(*) AS n FROM tx JOIN kw ON
  regexp_matches(t, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || replace(ngram, ' ', '\\s+') || '($|[^\\p{{L}}\\p{{N}}_])') GROUP BY ALL),
best AS (SELECT ticket_id, class, CAST(n AS DOUBLE) / (SELECT count(*) FROM kw k WHERE k.class = hit.class) AS conf FROM hit
  QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY conf DESC, class) = 1)
SELECT ticket_id, class AS rule_label, conf AS rule_confidence, CASE WHEN conf IS NOT NULL THEN 'rules' END AS rule_tier,
       CASE WHEN conf < 0.9 THEN 'escalate_to_tier2' WHEN conf >= 0.9 THEN 'auto_route' END AS rule_route, conf < 0.9 AS rule_abstain
FROM (SELECT ticket_id FROM tx) LEFT JOIN best USING (ticket_id)""")
def q_keyword_rule_predict(spark, sf):
    """R3 with the keywords that R2 mines from the same documents."""
    t = lg.tickets(spark, sf).select("ticket_id", "description")
    return rl.keyword_rule_table(t, "ticket_id", "description", _keywords(spark, sf)).drop("description")


# Scores of vectors: 20 times the inner product with the mean vector of each label, the means from two fifths
# of the rows; two further fifths are for fitting calibrators, which are applied to all.
SHARP = 20.0
SCORES_SQL = f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
m AS (SELECT label, list(a ORDER BY d) AS c FROM (
  SELECT label, d, avg(x) AS a FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e WHERE vec_id % 5 < 2) GROUP BY ALL)
  GROUP BY label),
lg AS (SELECT vec_id, any_value(e.label) AS y, list({SHARP} * list_dot_product(v, c) ORDER BY m.label) AS logits FROM e, m GROUP BY vec_id),
pr AS (SELECT vec_id, y, logits, list_transform(logits, lambda x: exp(x - list_max(logits)) /
         list_sum(list_transform(logits, lambda z: exp(z - list_max(logits))))) AS probs FROM lg)"""


def _vector_scores(spark, sf):
    from ticketlake.operators.retrieval import attach_scalars
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("y"), F.col("embedding").cast("array<double>").alias("v"))
    mean = (e.where("vec_id % 5 < 2").select("y", F.posexplode("v").alias("d", "x")).groupBy("y", "d").agg(F.avg("x").alias("a"))
            .groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "a"))), lambda s: s["a"]).alias("c"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "c"))), lambda s: s["c"]).alias("means")))  # one vector a label
    dot = F.transform("means", lambda c: F.lit(SHARP) * F.aggregate(F.zip_with("v", c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    rows = attach_scalars(e, mean).select("vec_id", "y", dot.alias("logits"))
    return rows.withColumn("probs", fe.softmax(F.col("logits")))


@fam.add("softmax", SCORES_SQL + " SELECT vec_id, list_transform(probs, lambda x: round(x, 9)) AS probs FROM pr")
def q_softmax(spark, sf):
    return _vector_scores(spark, sf).select("vec_id", F.transform("probs", lambda x: F.round(x, 9)).alias("probs"))


@fam.add("sigmoid", SCORES_SQL + " SELECT vec_id, list_transform(logits, lambda x: round(1.0 / (1.0 + exp(-x)), 9)) AS p FROM lg")
def q_sigmoid(spark, sf):
    return _vector_scores(spark, sf).select("vec_id", F.transform("logits", lambda x: F.round(fe.sigmoid(x), 9)).alias("p"))


CLASS_NAMES = [f"class {i}" for i in range(10)]


@fam.add("argmax_label", SCORES_SQL + """
SELECT vec_id, 'class ' || CAST(list_position(probs, list_max(probs)) - 1 AS VARCHAR) AS label, round(list_max(probs), 9) AS confidence FROM pr""")
def q_argmax_label(spark, sf):
    """F15 over the vectors' probabilities."""
    label, conf = fe.argmax_label(F.col("probs"), CLASS_NAMES)
    return _vector_scores(spark, sf).select("vec_id", label.alias("label"), F.round(conf, 9).alias("confidence"))


@fam.add("linear_head_logits", SCORES_SQL + " SELECT vec_id, list_transform(logits, lambda x: round(x, 6)) AS logits FROM lg")
def q_linear_head_logits(spark, sf):
    """F7's layer with the labels' mean vectors as weights (ten vectors, a model's size)."""
    e = table(spark, sf, "embeddings")
    means = (e.where("vec_id % 5 < 2").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
             .groupBy("label", "d").agg(F.avg("x").alias("a"))
             .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "a"))).alias("c")).orderBy("label").collect())
    weights = [[SHARP * x["a"] for x in r["c"]] for r in means]
    logits = ca.linear_head(e, "embedding", weights, [0.0] * len(weights))
    return e.select("vec_id", F.transform(logits, lambda x: F.round(x, 6)).alias("logits"))


def _passes_sql() -> str:
    """The passes of ``fit_temperature`` as one CTE each."""
    lo, hi = ca.TEMPERATURES
    out, n = [f"b0 AS (SELECT ln({lo}) AS lo, ln({hi}) AS hi)"], ca.GRID_POINTS
    for i in range(ca.PASSES):
        out.append(f"""g{i} AS (SELECT i, exp(lo + (hi - lo) * i / {n - 1}) AS t, lo, hi FROM b{i}, range({n}) r(i)),
n{i} AS (SELECT i, t, any_value(lo) AS lo, any_value(hi) AS hi,
  avg(ln(list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) / t)))) + list_max(logits) / t - logits[y + 1] / t) AS nll
  FROM (SELECT * FROM pr WHERE vec_id % 5 IN (2, 3)), g{i} GROUP BY i, t),
s{i} AS MATERIALIZED (SELECT * FROM n{i} ORDER BY nll, i LIMIT 1),
b{i + 1} AS (SELECT greatest(lo, ln(t) - (hi - lo) / {n - 1}) AS lo, least(hi, ln(t) + (hi - lo) / {n - 1}) AS hi FROM s{i})""")
    return ",\n".join(out) + f",\nbest AS (SELECT t AS temperature, nll FROM s{ca.PASSES - 1})"


FIT_SQL = SCORES_SQL + ",\n" + _passes_sql()


def _fit_temperature(rows):
    return ca.fit_temperature(rows.where("vec_id % 5 IN (2, 3)"), "logits", "y")


@fam.add("temperature_fit", FIT_SQL + " SELECT round(temperature, 6) AS temperature, round(nll, 6) AS nll FROM best")
def q_temperature_fit(spark, sf):
    """F11 on the vectors' scores against their labels."""
    return _fit_temperature(_vector_scores(spark, sf)).select(F.round("temperature", 6).alias("temperature"), F.round("nll", 6).alias("nll"))


@fam.add("temperature_apply", FIT_SQL + f""", z AS (
  SELECT vec_id, list_transform(probs, lambda p: ln(p + {ca.LOG_EPS}) / temperature) AS z FROM pr, best)
SELECT vec_id, list_transform(z, lambda x: round(exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z)))), 6)) AS probs FROM z""")
def q_temperature_apply(spark, sf):
    """probabilities of all vectors at the fitted temperature."""
    from ticketlake.operators.retrieval import attach_scalars
    rows = _vector_scores(spark, sf)
    df = attach_scalars(rows, _fit_temperature(rows).select("temperature"))
    return df.withColumn("p", ca.scale_probabilities(F.col("probs"), F.col("temperature"))).select(
        "vec_id", F.transform("p", lambda x: F.round(x, 6)).alias("probs"))


ISOTONIC_SQL = SCORES_SQL + """, pt AS (SELECT class_no, score, sum(hit) AS s, count(*) AS n FROM (
  SELECT unnest(probs) AS score, generate_subscripts(probs, 1) - 1 AS class_no, CAST(y = generate_subscripts(probs, 1) - 1 AS INTEGER) AS hit
  FROM pr WHERE vec_id % 5 IN (2, 3)) GROUP BY ALL),
cum AS (SELECT *, row_number() OVER w AS k, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM pt WINDOW w AS (PARTITION BY class_no ORDER BY score)),
ij AS (SELECT i.class_no, i.k AS i, j.k AS j, (j.cs - i.cs + i.s) / (j.cn - i.cn + i.n) AS mean FROM cum i JOIN cum j ON j.class_no = i.class_no AND j.k >= i.k),
lowest AS (SELECT class_no, i, j, min(mean) OVER (PARTITION BY class_no, i ORDER BY j DESC) AS m FROM ij),
knots AS MATERIALIZED (SELECT cum.class_no, score, max(m) AS y FROM lowest JOIN cum ON k = j AND cum.class_no = lowest.class_no GROUP BY ALL)"""


@fam.add("isotonic_fit", ISOTONIC_SQL + """
SELECT class_no, round(score, 9) AS score, round(y, 6) AS calibrated FROM (
  SELECT *, lag(y) OVER w AS before, lead(y) OVER w AS after FROM knots WINDOW w AS (PARTITION BY class_no ORDER BY score))
WHERE before IS NULL OR after IS NULL OR abs(y - before) > 1e-12 OR abs(after - y) > 1e-12""")
def q_isotonic_fit(spark, sf):
    """the corners of every label's curve."""
    curves = ca.fit_isotonic(_vector_scores(spark, sf).where("vec_id % 5 IN (2, 3)"), "probs", "y")
    return curves.select("class_no", F.explode(F.arrays_zip("xs", "ys")).alias("k")).select(
        "class_no", F.round("k.xs", 9).alias("score"), F.round("k.ys", 6).alias("calibrated"))


@fam.add("isotonic_apply", ISOTONIC_SQL + """, x AS (
  SELECT vec_id, unnest(probs) AS p, generate_subscripts(probs, 1) - 1 AS class_no FROM pr),
lo AS (SELECT x.*, k.score AS x0, k.y AS y0 FROM x ASOF LEFT JOIN knots k ON x.class_no = k.class_no AND x.p >= k.score),
hi AS (SELECT lo.*, k.score AS x1, k.y AS y1 FROM lo ASOF LEFT JOIN knots k ON lo.class_no = k.class_no AND lo.p < k.score),
c AS (SELECT vec_id, class_no, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (p - x0) / (x1 - x0) END AS q FROM hi),
l AS (SELECT vec_id, list(q ORDER BY class_no) AS q, sum(q) AS total FROM c GROUP BY vec_id)
SELECT vec_id, list_transform(q, lambda a: round(CASE WHEN total > 1e-9 THEN a / total ELSE a END, 6)) AS calibrated FROM l""")
def q_isotonic_apply(spark, sf):
    """all vectors, three fifths of which the curves have not seen."""
    rows = _vector_scores(spark, sf)
    out = ca.apply_isotonic(rows, ca.fit_isotonic(rows.where("vec_id % 5 IN (2, 3)"), "probs", "y"), "probs")
    return out.select("vec_id", F.transform("calibrated", lambda x: F.round(x, 6)).alias("calibrated"))


@fam.add("tier1_logreg")
def q_tier1_logreg(spark, sf):
    """language and priority of a document from its text, learned on the training split of F8; the rows
    are those of the other splits."""
    t = lg.tickets(spark, sf, with_priority=True)
    split = fe.stratified_split(lg.tickets(spark, sf).select("ticket_id", "category"), "category", "ticket_id").select("ticket_id", "split")
    rows = stored(t.join(split, "ticket_id"))
    predict = ca.fit_text_classifier(rows.where("split = 'train'"), "description", ["category", "priority"])
    out = predict(rows.where("split <> 'train'"))
    return out.select("ticket_id", "category", F.col("category_label").alias("label"), F.col("category_confidence").alias("confidence"),
                      "priority", "priority_label", "priority_confidence")


@fam.add("linear_head")
def q_linear_head(spark, sf):
    """the label of a vector from a linear layer over it, learned on four fifths; ``held_out`` rows are the rest."""
    e = table(spark, sf, "embeddings")
    w, b = ca.fit_linear_head(e.where("vec_id % 5 <> 0"), "embedding", "label")
    df = e.withColumn("logits", ca.linear_head(e, "embedding", w, b)).withColumn("p", fe.softmax(F.col("logits")))
    best = F.array_position("p", F.array_max("p")) - 1
    return df.select("vec_id", F.col("label").cast("int").alias("label"), best.cast("int").alias("predicted"),
                     F.array_max("p").alias("confidence"), (F.col("vec_id") % 5 == 0).alias("held_out"))


@fam.add("cost_report", COST_SQL + """, r AS (
  SELECT 'total' AS section, '' AS key, sum(cost_usd) AS c, count(*) AS call_count FROM uc
  UNION ALL SELECT 'component', component, sum(cost_usd), count(*) FROM uc GROUP BY component
  UNION ALL SELECT 'ticket', CAST(ticket_id AS VARCHAR), sum(cost_usd), count(*) FROM uc WHERE ticket_id IS NOT NULL GROUP BY ticket_id)
SELECT section, key, round(c, 9) AS total_cost_usd, call_count FROM r""")
def q_cost_report(spark, sf):
    """Totals, components and tickets written as one report and read back."""
    from ticketlake.plans.q_text import _scratch
    path = _scratch(spark, "cost-report")
    ev.write_cost_report(lg.usage(spark, sf), path)
    return spark.read.schema("section string, key string, total_cost_usd double, call_count long").json(path)
