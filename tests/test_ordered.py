"""Running values, ranks and medians on skewed groups, against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwright.operators.folds import fold_split, stratified_folds
from foldwright.operators.moments import exact_median
from foldwright.operators.ordered import Running, hash_rank, running


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 4000
    # two thirds of the rows share one key, and many rows share one timestamp
    key = np.where(rng.random(n) < 0.67, 1, rng.integers(2, 60, n))
    pdf = pd.DataFrame({"id": rng.permutation(n), "key": key, "t": rng.integers(0, 20, n), "v": rng.normal(size=n)})
    return pdf, spark.createDataFrame(pdf)


def test_running_equals_window(skewed):
    pdf, df = skewed
    out = running(
        df, ["key"], ["t", "id"],
        [Running("n", "count"), Running("total", "sum", "v"), Running("best", "min", "v", exclusive=True), Running("top", "max", "v")],
        partitions=13,
    ).toPandas().sort_values("id", ignore_index=True)
    want = pdf.sort_values(["key", "t", "id"])
    g = want.groupby("key")["v"]
    want = want.assign(n=g.cumcount() + 1, total=g.cumsum(), top=g.cummax(), best=g.cummin().groupby(want["key"]).shift(1)).sort_values("id", ignore_index=True)
    assert len(out) == len(pdf)
    assert (out["n"] == want["n"]).all()
    for c in ("total", "top", "best"):
        np.testing.assert_allclose(out[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9)


def test_running_without_key(skewed):
    pdf, df = skewed
    out = running(df, [], ["t", "id"], [Running("n", "count")], partitions=7).toPandas().sort_values(["t", "id"])
    assert out["n"].tolist() == list(range(1, len(pdf) + 1))


def test_groups_with_missing_keys_stay_whole(spark):
    df = spark.range(900).withColumn("key", F.when(F.col("id") % 3 > 0, F.lit(1)))
    out = running(df, ["key"], ["id"], [Running("n", "count")], partitions=6).toPandas()
    assert sorted(out[out["key"].isna()]["n"]) == list(range(1, 301)) and sorted(out[out["key"] == 1]["n"]) == list(range(1, 601))
    ranks = hash_rank(df, ["key"], "id").toPandas()
    assert sorted(ranks[ranks["key"].isna()]["rank"]) == list(range(1, 301))


def test_hash_rank_and_folds(skewed):
    pdf, df = skewed
    ranks = hash_rank(df, ["key"], "id").toPandas()
    for _, g in ranks.groupby("key"):
        assert sorted(g["rank"]) == list(range(1, len(g) + 1))
    folded = stratified_folds(df, 4, "key", "id").groupBy("key", "fold").count().toPandas()
    for _, g in folded.groupby("key"):
        if len(g) == 4:
            assert g["count"].max() - g["count"].min() <= 1


def test_fold_split_past_the_last(skewed):
    _, df = skewed
    folded = stratified_folds(df, 3, "key", "id")
    train, held = fold_split(folded, 9, 3)
    assert held.select("fold").distinct().collect()[0]["fold"] == 2
    assert train.join(held, "id").count() == 0
    assert train.count() + held.count() == df.count()


@pytest.mark.parametrize("values", [
    np.random.default_rng(1).normal(size=5001), np.exp(np.random.default_rng(2).normal(size=3000) * 8),
    np.repeat([3.0, 1.0, 2.0], [500, 300, 201]), np.array([1.0, 2.0, 3.0, 10.0]), np.array([5.0]),
    np.concatenate([np.zeros(1000), np.random.default_rng(3).normal(size=999)]),
])
def test_exact_median(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": values}))
    assert exact_median(df, ["k"], "x").first()["median"] == pytest.approx(np.median(values), abs=1e-12)


def test_median_of_many_groups(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.integers(0, 9, 4000), "x": rng.integers(0, 50, 4000).astype(float)})
    got = {r["k"]: r["median"] for r in exact_median(spark.createDataFrame(pdf), ["k"], "x").collect()}
    assert got == pdf.groupby("k")["x"].median().to_dict()
