"""Tables as folders of part files, and plans whose tasks do not grow with the table."""

import pytest

import workloads.catalog as catalog
import workloads.search as search
from foldwright.functions.exprs import project_step
from foldwright.operators.linear import pair_votes
from foldwright.operators.moments import exact_median
from foldwright.plans import candidates as C
from foldwright.plans.space import CONSTANT_STEPS, STEP_NAMES, VARIABLE_STEPS
from foldwright.sources import datasets as D
from foldwright.streaming.incremental import run_available, stream_table, streaming_moments


@pytest.mark.parametrize("parts", [0, 3])
def test_streams_read_a_table_in_part_files(spark, tmp_path, parts):
    rows = [(i, [float(i), 1.0], i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    path = f"{tmp_path}/embeddings.parquet"
    if parts:
        df.repartition(parts).write.parquet(path)
    else:
        df.toPandas().to_parquet(path)
    got = catalog.QUERIES["streaming_class_moments"](spark, str(tmp_path)).collect()
    assert {(r["label"], r["pos"]): (r["n"], r["mean"]) for r in got} == {(0, 0): (6, 5.0), (1, 0): (6, 6.0), (0, 1): (6, 1.0), (1, 1): (6, 1.0)}


def test_stream_without_files_gives_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = stream_table(spark, f"{tmp_path}/in", spark.createDataFrame([], "label int, features array<double>").schema)
    assert run_available(streaming_moments(stream, "label", "features"), "m", f"{tmp_path}/out", f"{tmp_path}/state").count() == 0


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_median_sorts_no_column_in_one_task(spark):
    df = spark.range(2000).selectExpr("id % 2 AS pos", "double(id) AS x")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        median = exact_median(df, ["pos"], "x")
        assert "SortMergeJoin" not in planned(median)
        assert {r["pos"]: r["median"] for r in median.collect()} == {0: 999.0, 1: 1000.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_drawing_is_spread_by_the_number_of_ids(spark, tmp_path, monkeypatch):
    spark.range(1000).withColumnRenamed("id", "o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(search, "IDS_PER_TASK", 20, raising=False)
    ids = search._ids(spark, str(tmp_path))
    assert ids.rdd.getNumPartitions() >= 50
    assert max(ids.rdd.glom().map(len).collect()) <= 40 and ids.distinct().count() == 1000


def test_drawn_steps_are_the_projection_of_the_whole(spark):
    ids = spark.range(300)
    whole = C.draw_candidates(ids, "id")
    for steps in (CONSTANT_STEPS, VARIABLE_STEPS, ["imputation", "rescaling"]):
        want = {r["id"]: r["c"] for r in whole.select("id", project_step("config", steps).alias("c")).collect()}
        assert {r["id"]: r["config"] for r in C.draw_candidates(ids, "id", steps=steps).collect()} == want
    want = {tuple(r) for r in C.with_choices(whole).select("id", *STEP_NAMES).collect()}
    assert {tuple(r) for r in C.draw_choices(ids, "id").collect()} == want


def test_info_of_many_datasets_needs_few_files(spark, tmp_path):
    text = "task = 'binary.classification'\nmetric = 'bac_metric'\nfeat_num = {n}\nlabel_num = 2\nis_sparse = 0\nnote"
    rows = [(f"set{n}_public.info", text.format(n=n)) for n in range(300)]
    D.write_packed_info(spark.createDataFrame(rows, "file string, value string").coalesce(2), f"{tmp_path}/info")
    assert len(list((tmp_path / "info").rglob("*.txt"))) <= 2
    got = D.read_packed_info(spark, f"{tmp_path}/info").collect()
    assert {(r["name"], r["feat_num"], r["task"], len(r["info"])) for r in got} == {(f"set{n}", n, 1, 5) for n in range(300)}


def test_pair_votes_shuffle_the_sums_once(spark):
    rows = [(1, 0, 1, 0.5), (1, 0, 2, -0.5), (1, 1, 2, 0.25), (2, 0, 1, -1.0), (2, 0, 2, 2.0), (2, 1, 2, None)]
    votes = pair_votes(spark.createDataFrame(rows, "row_id bigint, i int, j int, decision double"))
    got = {(r["row_id"], r["class"]): r["score"] for r in votes.collect()}
    # the largest summed confidence is 2, so a quarter of each is added to the votes
    want = {(1, 0): 1.0, (1, 1): 1.0625, (1, 2): 0.9375, (2, 0): 0.75, (2, 1): 0.75, (2, 2): 0.5}
    assert got == pytest.approx(want)
    assert "ReusedExchange" in planned(votes)
