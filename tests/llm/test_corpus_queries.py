"""The registered corpus queries against their SQL or brute force on the given tables, and the pipeline stage by stage."""

import pytest
from oracle import compare

import corpus_pipeline
from foldwright.llm.common import read
from foldwright.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, sf_dir, name):
    ok, note = compare(spark, duck, name, QUERIES[name], ORACLE[name], sf_dir)
    assert ok, note


def test_every_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13


def test_languages_found(spark, duck):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op2_language_mixture"](spark, sf).join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_vectors_recall(spark, duck):
    ok, note = compare(spark, duck, "op10", QUERIES["op10_vector_duplicates"], ORACLE["op10_vector_duplicates"], "/root/testdata/sf0.01")
    assert ok, note


def test_stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        if name != "pieces":
            assert out.columns == docs.columns, name
        if name == "language":
            assert out.count() >= 0.99 * docs.count()
        if name == "exact":
            assert {r["text"] for r in out.collect()} <= {r["text"] for r in docs.collect()}
            assert out.count() == QUERIES["op3_exact_dedup"](spark, sf_dir).filter("kept").count()
        if name == "pieces":
            assert out.count() == docs.count()
        docs = out
