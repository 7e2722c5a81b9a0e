"""Memory of the workers: batches are small and what they leave is given back."""

import pyarrow as pa

import corpus_pipeline
from foldwright.llm import common


def test_stages_with_workers_take_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(1, "a few words", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get(key)
    try:
        for stage in (corpus_pipeline.language, corpus_pipeline.near, corpus_pipeline.piece_ids):
            spark.conf.set(key, 10_000)
            stage(spark, docs, "")
            assert spark.conf.get(key) == "2000"
        spark.conf.set(key, 500)
        common.smaller_batches(spark)
        assert spark.conf.get(key) == "500"
    finally:
        spark.conf.set(key, before)


def test_memory_is_given_back_after_each_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release_memory", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None, "b"])], ["text"])
    assert [t for _, texts in common.pieces(iter([batch, batch]), "text") for t in texts] == ["a", "", "b"] * 2
    assert len(calls) == 2
    monkeypatch.undo()
    common.release_memory()
