"""The pipeline against a plain version of its stages, and its registration."""

from __future__ import annotations

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as P
from tests.conftest import SF_SMALL
from tests.llm import common as C
from tests.llm.test_dedup import components, fingerprint
from ticketlake.llm import decontaminate as D
from ticketlake.llm import toxicity as T
from ticketlake.llm.common import benchmark, documents, labels, stage


def test_registered():
    names = E.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "bpe_encode"]


def test_stages(spark):
    docs = documents(spark, SF_SMALL)
    rows = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in T.toxicity(docs, labels(spark, SF_SMALL)).where("predicted = 1").collect()}
    left = {i: t for i, t in rows.items() if i not in toxic}
    last = {t: max(j for j, u in left.items() if u == t) for t in left.values()}
    left = {i: t for i, t in left.items() if last[t] == i}
    comp = components({i: fingerprint(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if comp[i] == i}
    match = D.ItemMatcher([(r.item_id, r.text) for r in benchmark(spark, SF_SMALL).collect()])
    left = {i: t for i, t in left.items() if not match(t)}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r.ids for r in P.run(spark, SF_SMALL).collect()}
    assert got == {i: lib.encode(t, add_special_tokens=False).ids for i, t in left.items()}


def test_benchmark_passages_and_only_those_are_dropped(spark):
    docs = documents(spark, SF_SMALL)
    con = duckdb.connect()
    want = {r[0] for r in con.execute(f"""SELECT DISTINCT doc_id FROM '{SF_SMALL}/documents.parquet' d,
                                          '{SF_SMALL}/benchmark.parquet' b WHERE contains(d.text, b.text)""").fetchall()}
    kept = {r.doc_id for r in P.drop_contaminated(spark, docs, SF_SMALL).select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").collect()} - kept == want


def test_stages_keep_columns_and_take_odd_rows(spark):
    docs = C.docs(spark)
    for _, f in P.STAGES[:-1]:
        out = stage(f(spark, docs, SF_SMALL))
        assert out.columns == docs.columns
        assert f(spark, C.empty(spark), SF_SMALL).count() == 0
        docs = out
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert ids.count(7) == 1 and 13 in ids or -3 in ids
    assert P.encode(spark, docs, SF_SMALL).count() == len(ids)
