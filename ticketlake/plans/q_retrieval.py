"""Queries for chunking and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlake.functions import text as tx
from ticketlake.operators import chunking as ck
from ticketlake.operators import lexical_index as lx
from ticketlake.operators import retrieval as rt
from ticketlake.plans.common import Family, docs
from ticketlake.session import cut_lineage
from ticketlake.sources.tables import scan_chunks, table

fam = Family()

TOK = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


def sql_tokens(x: str) -> str:
    return TOK.format(x=x)


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{tx.SPACE}+'), lambda w: w <> '')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{tx.SPACE}+|{tx.SPACE}+$', '', 'g')"


def sql_pack(p: str) -> str:
    sents = f"string_split(replace(replace({p}, '?', '?.'), '!', '!.'), '. ')"
    step = (f"lambda acc, s: CASE WHEN len(acc.cur) + len({sql_words('s')}) > {ck.CHUNK_WORDS} AND len(acc.cur) > 0 "
            f"THEN {{'chunks': list_append(acc.chunks, array_to_string(acc.cur, ' ')), 'cur': {sql_words('s')}}} "
            f"ELSE {{'chunks': acc.chunks, 'cur': list_concat(acc.cur, {sql_words('s')})}} END")
    init = "{'chunks': []::VARCHAR[], 'cur': []::VARCHAR[]}"
    fin = f"list_reduce({sents}, {step}, {init})"
    packed = (f"CASE WHEN len(({fin}).cur) > 0 THEN list_append(({fin}).chunks, array_to_string(({fin}).cur, ' ')) "
              f"ELSE ({fin}).chunks END")
    return f"CASE WHEN len({sql_words(p)}) <= {ck.CHUNK_WORDS} THEN [{p}] ELSE {packed} END"


def sql_paragraphs(text: str) -> str:
    return f"list_filter(list_transform(string_split({text}, chr(10) || chr(10)), lambda p: {sql_strip('p')}), lambda p: p <> '')"


SQL_CHUNK_LISTS = (f"list_filter(flatten(list_transform({sql_paragraphs('text')}, lambda p: {sql_pack('p')})), "
                   f"lambda c: len({sql_words('c')}) >= {ck.MIN_CHUNK_WORDS})")

KB_CHUNKS_SQL = f"""kb_chunks AS MATERIALIZED (
  SELECT doc_id * {ck.CHUNK_ID_STRIDE} + pos - 1 AS chunk_id, doc_id, CAST(pos - 1 AS BIGINT) AS chunk_no, source, text
  FROM (SELECT doc_id, source, unnest(cs) AS text, generate_subscripts(cs, 1) AS pos
        FROM (SELECT doc_id, source, {SQL_CHUNK_LISTS} AS cs FROM documents)))"""

BM25_SQL = f"""toks AS MATERIALIZED (SELECT chunk_id, {sql_tokens('text')} AS toks FROM kb_chunks),
postings AS MATERIALIZED (
  SELECT term, chunk_id, dl, count(*) AS tf
  FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM toks) GROUP BY term, chunk_id, dl),
ntot AS (SELECT count(*) AS n_docs, CAST(sum(len(toks)) AS DOUBLE) / count(*) AS avgdl FROM toks),
dfreq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
idf_raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf_raw FROM dfreq, ntot),
idf_mean AS (SELECT avg(idf_raw) AS mean_idf FROM idf_raw),
idf AS (SELECT term, df, CASE WHEN idf_raw < 0 THEN {rt.BM25_EPSILON} * mean_idf ELSE idf_raw END AS idf
        FROM idf_raw, idf_mean)"""

QUERIES_SQL = "bq AS (SELECT item_id AS query_id, text FROM benchmark)"

BM25_SCORE_SQL = f"""qt AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest({sql_tokens('text')}) AS term FROM bq) GROUP BY query_id, term),
bm25 AS (
  SELECT query_id, chunk_id,
         round(sum(qtf * idf * (tf * {rt.BM25_K1 + 1}) / (tf + {rt.BM25_K1} * ({1 - rt.BM25_B} + {rt.BM25_B} * dl / avgdl))), 9) AS score
  FROM qt JOIN idf USING (term) JOIN postings USING (term), ntot GROUP BY query_id, chunk_id),
bm25_top AS (
  SELECT q.query_id, c.chunk_id, coalesce(s.score, 0.0) AS score,
         CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(s.score, 0.0) DESC, c.chunk_id DESC) - 1 AS INTEGER) AS rank
  FROM bq q CROSS JOIN kb_chunks c LEFT JOIN bm25 s ON s.query_id = q.query_id AND s.chunk_id = c.chunk_id
  QUALIFY rank < {rt.RECALL_TOP_K})"""

COS_SQL = f"""qtf AS (SELECT query_id AS id, term, CAST(count(*) AS DOUBLE) AS tf
             FROM (SELECT query_id, unnest({sql_tokens('text')}) AS term FROM bq) GROUP BY ALL),
ctf AS (SELECT chunk_id AS id, term, CAST(count(*) AS DOUBLE) AS tf
        FROM (SELECT chunk_id, unnest({sql_tokens('text')}) AS term FROM kb_chunks) GROUP BY ALL),
qv AS (SELECT id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM qtf),
cv AS (SELECT id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM ctf),
cos AS (SELECT qv.id AS query_id, cv.id AS chunk_id, round(sum(qv.w * cv.w), 9) AS score
        FROM qv JOIN cv USING (term) GROUP BY ALL),
cos_top AS (
  SELECT q.query_id, c.chunk_id, coalesce(s.score, 0.0) AS score,
         CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(s.score, 0.0) DESC, c.chunk_id ASC) - 1 AS INTEGER) AS rank
  FROM bq q CROSS JOIN kb_chunks c LEFT JOIN cos s ON s.query_id = q.query_id AND s.chunk_id = c.chunk_id
  QUALIFY rank < {rt.RECALL_TOP_K})"""

FUSION_SQL = f"""lists AS (
  SELECT query_id, 0 AS list_no, rank, chunk_id FROM bm25_top
  UNION ALL SELECT query_id, 1 AS list_no, rank, chunk_id FROM cos_top),
fused AS (
  SELECT query_id, chunk_id, round(sum(1.0 / ({rt.RRF_K} + rank + 1)), 9) AS rrf_score,
         min(list_no * 100000 + rank) AS first_seen
  FROM lists GROUP BY query_id, chunk_id),
fused_top AS (
  SELECT query_id, chunk_id, rrf_score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first_seen) - 1 AS INTEGER) AS fusion_rank
  FROM fused QUALIFY fusion_rank < {rt.RRF_TOP_N}),
cand AS (
  SELECT f.*, c.source, c.text, q.text AS query_text,
         CASE WHEN len(list_distinct({sql_tokens('q.text')})) > 0
              THEN round(CAST(len(list_intersect(list_distinct({sql_tokens('q.text')}), list_distinct({sql_tokens('c.text')}))) AS DOUBLE)
                         / len(list_distinct({sql_tokens('q.text')})), 9)
              ELSE 0.0 END AS rerank_score
  FROM fused_top f JOIN kb_chunks c USING (chunk_id) JOIN bq q USING (query_id)),
reranked AS (
  SELECT query_id, chunk_id, source, text, rerank_score, fusion_rank, rrf_score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fusion_rank) - 1 AS INTEGER) AS rank
  FROM cand QUALIFY rank < {rt.FINAL_TOP_K})"""


def with_all(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def kb(spark, sf):
    """KB chunks, materialised once into the checkpoint folder: every retrieval
    branch (index, padding, vectors, metadata) reads them without re-chunking."""
    return cut_lineage(ck.chunk_kb(docs(spark, sf)))


def bench_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# ---- K1-K3 -------------------------------------------------------------------------------

@fam.add("split_paragraphs", f"""
SELECT doc_id, CAST(len(ps) AS BIGINT) AS n_paragraphs, array_to_string(ps, '|') AS paragraphs
FROM (SELECT doc_id, {sql_paragraphs("replace(text, '. ', '.' || chr(10) || chr(10))")} AS ps FROM documents)""")
def q_split_paragraphs(spark, sf):
    """K1 on text with blank lines (every ". " becomes a paragraph break here)."""
    t = F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n"))
    ps = ck.split_paragraphs(t)
    return docs(spark, sf).select("doc_id", F.size(ps).cast("long").alias("n_paragraphs"),
                                  F.array_join(ps, "|").alias("paragraphs"))


@fam.add("pack_sentences", f"""
SELECT doc_id, CAST(len(cs) AS BIGINT) AS n_chunks, array_to_string(cs, '|') AS chunks
FROM (SELECT doc_id, {sql_pack(sql_strip('text'))} AS cs FROM documents)""")
def q_pack_sentences(spark, sf):
    from ticketlake.functions.text import strip_unicode
    cs = ck.pack_sentences(strip_unicode(F.col("text")))
    return docs(spark, sf).select("doc_id", F.size(cs).cast("long").alias("n_chunks"),
                                  F.array_join(cs, "|").alias("chunks"))


@fam.add("chunk_kb", with_all(KB_CHUNKS_SQL) + "SELECT chunk_id, doc_id, chunk_no, source, text FROM kb_chunks")
def q_chunk_kb(spark, sf):
    return kb(spark, sf)


# ---- K4-K6 -------------------------------------------------------------------------------

@fam.add("scan_chunks", with_all(KB_CHUNKS_SQL) + "SELECT source, chunk_id, text FROM kb_chunks")
def q_scan_chunks(spark, sf):
    """KB chunks written as JSON lines, scanned back with a fixed schema."""
    from ticketlake.plans.q_text import _scratch
    path = _scratch(spark, "chunks-jsonl")
    ck.chunk_kb(docs(spark, sf)).select("source", "chunk_id", "text").write.json(path)
    return scan_chunks(spark, path)


@fam.add("bm25_stats", with_all(KB_CHUNKS_SQL, BM25_SQL) + """
SELECT term, df, round(idf, 9) AS idf FROM idf""")
def q_bm25_stats(spark, sf):
    idx = rt.bm25_stats(kb(spark, sf))
    return idx.idf.select("term", "df", F.round("idf", 9).alias("idf"))


@fam.add("bm25_score", with_all(KB_CHUNKS_SQL, BM25_SQL, QUERIES_SQL, BM25_SCORE_SQL) + """
SELECT query_id, chunk_id, score FROM bm25""")
def q_bm25_score(spark, sf):
    s = rt.bm25_score(bench_queries(spark, sf), rt.bm25_stats(kb(spark, sf)))
    return s.select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@fam.add("bm25_topk", with_all(KB_CHUNKS_SQL, BM25_SQL, QUERIES_SQL, BM25_SCORE_SQL) + """
SELECT query_id, chunk_id, rank, score FROM bm25_top""")
def q_bm25_topk(spark, sf):
    return rt.bm25_topk(bench_queries(spark, sf), kb(spark, sf)).select("query_id", "chunk_id", "rank", "score")


# ---- K7-K9, K13 ------------------------------------------------------------------------------

@fam.add("l2_normalize", """
SELECT vec_id, list_transform(v, lambda x: CASE WHEN nrm > 0 THEN round(x / nrm, 9) ELSE 0.0 END) AS embedding
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
             sqrt(list_reduce(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x), lambda a, b: a + b, 0.0)) AS nrm
      FROM embeddings)""")
def q_l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.transform(rt.l2_normalize(F.col("embedding")), lambda x: F.round(x, 9)).alias("embedding"))


def _dense_sql(k: int) -> str:
    return f"""
SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
       round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS score,
       CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]),
            CAST(c.embedding AS DOUBLE[])), 9) DESC, c.vec_id) - 1 AS INTEGER) AS rank
FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id
QUALIFY rank < {k}"""


def vector_queries(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("query_id"), "embedding")


@fam.add("dense_topk", _dense_sql(rt.RECALL_TOP_K))
def q_dense_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return rt.dense_topk(e, vector_queries(spark, sf), k=rt.RECALL_TOP_K, exclude_self=True).select(
        "query_id", "chunk_id", "score", "rank")


@fam.add("naive_retrieve", _dense_sql(3))
def q_naive_retrieve(spark, sf):
    """Single-stage baseline, dense top 3 of the raw query."""
    e = table(spark, sf, "embeddings")
    return rt.dense_topk(e, vector_queries(spark, sf), k=3, exclude_self=True).select(
        "query_id", "chunk_id", "score", "rank")


@fam.add("dense_topk_lsh")
def q_dense_topk_lsh(spark, sf):
    e = table(spark, sf, "embeddings")
    return rt.dense_topk_lsh(e, vector_queries(spark, sf), k=rt.RECALL_TOP_K, exclude_self=True).select(
        "query_id", "chunk_id", "score", "rank")


# ---- K10-K12 ---------------------------------------------------------------------------------

PIPE_SQL = with_all(KB_CHUNKS_SQL, BM25_SQL, QUERIES_SQL, BM25_SCORE_SQL, COS_SQL, FUSION_SQL)


def _fused(spark, sf):
    q = bench_queries(spark, sf)
    chunks = kb(spark, sf)
    found = lx.search(q, rt.bm25_stats(chunks), (lx.BM25, lx.COSINE))
    return q, chunks, rt.rrf_fusion(found.select("query_id", F.col("kind").alias("list_no"), "rank", "chunk_id"))


@fam.add("rrf_fusion", PIPE_SQL + "SELECT query_id, chunk_id, rrf_score, fusion_rank FROM fused_top")
def q_rrf_fusion(spark, sf):
    return _fused(spark, sf)[2]


@fam.add("rerank_topk", PIPE_SQL + "SELECT query_id, chunk_id, rank, rerank_score FROM reranked")
def q_rerank_topk(spark, sf):
    q, chunks, fused = _fused(spark, sf)
    cand = rt.with_chunk_meta(fused, chunks).join(q.select("query_id", F.col("text").alias("query_text")), "query_id")
    return rt.rerank_topk(cand).select("query_id", "chunk_id", "rank", "rerank_score")


@fam.add("two_stage_retrieve", PIPE_SQL + """
SELECT query_id, rank, chunk_id, source, text, rerank_score, fusion_rank, rrf_score FROM reranked""")
def q_two_stage_retrieve(spark, sf):
    return rt.two_stage_retrieve(bench_queries(spark, sf), kb(spark, sf))


# ---- K14-K16 ---------------------------------------------------------------------------------

GATE_SQL = f"""per_q AS (SELECT query_id, max(coalesce(rerank_score, 0.0)) AS mx, count(*) AS n,
                 list(coalesce(source, '') ORDER BY rank) AS sources FROM reranked GROUP BY query_id),
gated AS (
  SELECT q.query_id, (p.n IS NULL OR p.mx < {rt.GATE_THRESHOLD}) AS should_abstain,
         CASE WHEN p.n IS NULL THEN 0.0 ELSE p.mx END AS max_score,
         CASE WHEN p.n IS NULL THEN 'no_chunks_retrieved'
              WHEN p.mx < {rt.GATE_THRESHOLD} THEN 'max_rerank_score_below_threshold' END AS reason,
         coalesce(p.sources, []::VARCHAR[]) AS sources
  FROM bq q LEFT JOIN per_q p USING (query_id))"""


def _gated(spark, sf):
    q = bench_queries(spark, sf)
    return q, rt.abstention_gate(q, rt.two_stage_retrieve(q.where(rt.has_text(F.col("text"))), kb(spark, sf)))


@fam.add("abstention_gate", PIPE_SQL.rstrip() + ",\n" + GATE_SQL + """
SELECT query_id, should_abstain, max_score, reason FROM gated""")
def q_abstention_gate(spark, sf):
    return _gated(spark, sf)[1].select("query_id", "should_abstain", "max_score", "reason")


@fam.add("gate_output", PIPE_SQL.rstrip() + ",\n" + GATE_SQL + f"""
SELECT query_id, should_abstain AS abstain_flag,
       CASE WHEN should_abstain THEN '{rt.ABSTAIN_RESPONSE_TEXT}' END AS draft_response,
       CASE WHEN should_abstain THEN []::INTEGER[] END AS citations,
       CASE WHEN should_abstain THEN sources END AS top_3_sources,
       max_score AS retrieval_max_score
FROM gated""")
def q_gate_output(spark, sf):
    return rt.gate_output(_gated(spark, sf)[1])


@fam.add("retrieval_fallbacks", PIPE_SQL.rstrip() + ",\n" + GATE_SQL + """,
st AS (
  SELECT g.query_id, q.text AS cleaned_text, CASE WHEN g.should_abstain THEN g.sources END AS top_3_sources,
         g.max_score AS retrieval_max_score, g.sources AS chunk_sources, g.max_score AS chunk_max_score,
         g.should_abstain AS abstain_flag
  FROM gated g JOIN bq q USING (query_id))
SELECT query_id,
       CASE WHEN coalesce(trim(cleaned_text), '') = '' THEN []::VARCHAR[]
            WHEN len(coalesce(top_3_sources, [])) > 0 THEN top_3_sources
            ELSE coalesce(chunk_sources, []::VARCHAR[]) END AS final_sources,
       CASE WHEN coalesce(trim(cleaned_text), '') = '' THEN 0.0
            WHEN coalesce(retrieval_max_score, 0.0) <> 0 THEN retrieval_max_score
            ELSE greatest(0.0, coalesce(chunk_max_score, 0.0)) END AS final_max_score,
       (coalesce(trim(cleaned_text), '') = '' OR coalesce(abstain_flag, TRUE)) AS final_abstain
FROM st""")
def q_retrieval_fallbacks(spark, sf):
    q, g = _gated(spark, sf)
    st = g.join(q, "query_id").select(
        "query_id", F.col("text").alias("cleaned_text"),
        F.when(F.col("should_abstain"), F.col("sources")).alias("top_3_sources"),
        F.col("max_score").alias("retrieval_max_score"), F.col("sources").alias("chunk_sources"),
        F.col("max_score").alias("chunk_max_score"), F.col("should_abstain").alias("abstain_flag"))
    return rt.retrieval_fallbacks(st).select("query_id", "final_sources", "final_max_score", "final_abstain")
