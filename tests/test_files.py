"""Readers on small hand-written files, streams over several files, and shared evaluation."""

import pandas as pd
import pytest

from foldwright.operators.folds import stratified_folds
from foldwright.plans.evaluate import evaluate
from foldwright.plans.runlog import within_budget
from foldwright.plans.space import FORBIDDEN_PAIRS, NODES, parse_space
from foldwright.plans.candidates import legal_table
from foldwright.sources import datasets as D
from foldwright.streaming.incremental import run_available, stream_table, streaming_moments
from foldwright.operators.moments import moments
from workloads.base import vectors
from workloads.selection import CONFIGS


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_row_numbers_over_many_splits(spark, tmp_path):
    path = put(tmp_path, "long.data", "".join(f"{i} {i % 7}\n" + ("% skip\n" if i % 5 == 0 else "") for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = D.read_dense(spark, path, 2)
        assert df.rdd.getNumPartitions() > 4
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["row_id"], int(r["features"][0])) for r in rows) == [(i, i) for i in range(20000)]


def test_dense_keeps_first_columns_and_rejects_short_lines(spark, tmp_path):
    path = put(tmp_path, "a.data", "% c\n1 2 3\n\n4 5 6\n")
    assert [list(r["features"]) for r in D.read_dense(spark, path, 2).orderBy("row_id").collect()] == [[1, 2], [4, 5]]
    with pytest.raises(Exception, match="fewer columns"):
        D.read_dense(spark, path, 4).collect()


def test_sparse_and_binary(spark, tmp_path):
    path = put(tmp_path, "s.data", "1:0.5 3:2\n2:1 2:4 \n")
    rows = D.read_sparse(spark, path).orderBy("row_id").collect()
    assert rows[0]["cells"] == {0: 0.5, 2: 2.0} and rows[1]["cells"] == {1: 4.0}
    path = put(tmp_path, "b.data", "3 1\n2\n")
    rows = D.read_binary_sparse(spark, path).orderBy("row_id").collect()
    assert [r["active"] for r in rows] == [[0, 2], [1]]
    assert D.detect_format(D.read_lines(spark, path)).first()["format"] == "sparse_binary"
    assert D.detect_format(D.read_lines(spark, path), 0).first()["format"] == "dense"


def test_load_dataset_folder(spark, tmp_path):
    folder = tmp_path / "toy"
    folder.mkdir()
    put(folder, "toy_public.info", "task = 'multiclass.classification'\nmetric = 'bac_metric'\nfeat_type = 'Categorical'\nfeat_num = 2\nlabel_num = 2\nis_sparse = 0\n")
    for split, n in (("train", 3), ("valid", 1), ("test", 2)):
        put(folder, f"toy_{split}.data", "".join(f"{i} {i + 1} \n" for i in range(n)))
        put(folder, f"toy_{split}.solution", "".join("0 1\n" if i % 2 else "1 0\n" for i in range(n)))
    df = D.load_dataset(spark, str(folder) + "/")
    got = {(r["split"], r["row_id"]): (list(r["features"]), r["label"]) for r in df.collect()}
    assert len(got) == 6 and got[("train", 1)] == ([1.0, 2.0], 1) and got[("test", 0)] == ([0.0, 1.0], 0)
    info = D.read_info(spark, f"{folder}/*_public.info")
    types = D.read_feature_types(spark, info).first()
    assert types["types"] == ["Categorical", "Categorical"]
    put(folder, "toy_feat.type", "Numerical\nCategorical\n")
    assert D.read_feature_types(spark, info, f"{folder}/*_feat.type").first()["types"] == ["Numerical", "Categorical"]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    df = vectors(spark, sf_dir).select("label", "features")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = stream_table(spark, str(tmp_path / "in"), df.schema, files_per_trigger=2)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    got = run_available(streaming_moments(stream, "label", "features"), "m", out, state).toPandas().sort_values(["label", "pos"], ignore_index=True)
    want = moments(df, ["label"]).toPandas().sort_values(["label", "pos"], ignore_index=True)
    pd.testing.assert_frame_equal(got[want.columns.tolist()], want, rtol=1e-9)


def test_sharing_prefixes_changes_no_cost(spark, sf_dir):
    rows = stratified_folds(vectors(spark, sf_dir), 2)
    shared = {(r["config_id"], r["fold"]): r for r in evaluate(rows, CONFIGS, 10, 2).collect()}
    alone = {(r["config_id"], r["fold"]): r for r in evaluate(rows, CONFIGS, 10, 2, share_prefix=False).collect()}
    assert shared.keys() == alone.keys() and len(shared) == 8
    for key, row in shared.items():
        assert row["cost"] == pytest.approx(alone[key]["cost"])
        assert not alone[key]["prefix_hit"]
        if key[0] == "broken-qda":
            assert row["status"] == "CRASHED" and row["cost"] == 1234567890
        else:
            assert 0 < row["cost"] < 1
    assert sum(r["prefix_hit"] for r in shared.values()) == 4


def test_space(spark):
    assert parse_space("pca,no_preprocessing-lda, sgd") == (["pca", "no_preprocessing"], ["lda", "sgd"])
    assert len(NODES) == 35 and len(FORBIDDEN_PAIRS) == 21
    table = legal_table(spark)
    assert table.count() == 4 * 780
    # an unsigned dense table: the count model is legal only behind a step that makes the data signed
    rows = table.filter("NOT sparse AND NOT signed AND classifier = 'multinomial_nb' AND legal")
    assert {r["rescaling"] for r in rows.filter("feature_preprocessor = 'no_preprocessing'").collect()} == {"minmax"}


def test_budget_limits_are_strict(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "eval int, wallclock_time double")
    assert within_budget(df, 20.0, None).count() == 2
    assert within_budget(df, None, 2).count() == 2
    assert within_budget(df).count() == 3
