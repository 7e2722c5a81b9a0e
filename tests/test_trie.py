"""Trie evaluation against one evaluation per configuration and fold; records, admission, failures, weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.operators.folds import stratified_folds
from foldwright.operators.select import by_rate, top_percentile
from foldwright.plans import trie
from foldwright.plans.evaluate import evaluate
from foldwright.plans.runlog import cumulative_hits, mean_cost
from foldwright.sources.runlog_files import RUN_SCHEMA, append_run_log, read_run_log
from workloads.base import vectors
from workloads.selection import CONFIGS, TRIE_CONFIGS, make_config, order_rows

P = "feature_preprocessor:"
MORE = [
    ("rates", make_config("minmax", "select_rates", "bernoulli_nb", **{P + "select_rates:score_func": "f_classif", P + "select_rates:alpha": "0.4"})),
    ("pca", make_config("standard_scaler", "pca", "gaussian_nb", **{P + "pca:keep_variance": "0.9"})),
    ("pca-lda", make_config("standard_scaler", "pca", "lda", **{P + "pca:keep_variance": "0.9"})),
    ("poly", make_config("no_rescaling", "polynomial_features", "gaussian_nb", **{P + "polynomial_features:interaction_only": "True"})),
    ("median", make_config("minmax", "no_preprocessing", "multinomial_nb", **{"imputation:imputer:strategy": "median"})),
    ("nothing-left", make_config("minmax", "select_rates", "gaussian_nb", **{P + "select_rates:alpha": "0.0000001"})),
]


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    few = F.transform("features", lambda x, i: F.when((F.col("row_id") + i) % 17 != 0, x))
    return stratified_folds(vectors(spark, sf_dir).withColumn("features", F.slice(few, 1, 12)), 3).persist()


@pytest.mark.parametrize("least", [0.0, 1e9])
def test_equals_single_evaluations(rows, least):
    """The costs do not depend on sharing, nor on which tables are stored."""
    configs = [*CONFIGS, *MORE]
    alone = {(r["config_id"], r["fold"]): r for r in evaluate(rows, configs, 10, 3, share_prefix=False).collect()}
    got = {(r["config_id"], r["instance"]): r for r in trie.evaluate_trie(rows, configs, 10, 3, minimum_seconds=least).collect()}
    assert got.keys() == alone.keys()
    for key, r in got.items():
        assert (r["status"], pytest.approx(r["cost"])) == (alone[key]["status"], alone[key]["cost"]), key
    assert {k[0] for k, r in got.items() if r["status"] == "CRASHED"} == {"broken-qda", "nothing-left"}


def test_records(spark, sf_dir, tmp_path):
    out = trie.evaluate_trie(order_rows(spark, sf_dir), TRIE_CONFIGS, 3, 3, categorical=[2], stamp="s1")
    runs = out.collect()
    # two cached steps a run; the second to fourth configuration of a strategy find the imputation, their own preprocessing is new
    assert [r["prefix_hits"] for r in runs] == ([0] * 3 + [1] * 9) * 2
    assert [r["total_evaluations"] for r in runs] == list(range(2, 50, 2)) and runs[-1]["cache_hits"] == 18
    for r in runs:
        assert r["runtime"] == pytest.approx(sum(r["pipeline_steps_timing"].values())) and (r["runtime_reduction_by_caching"] > 0) == (r["prefix_hits"] > 0)
        assert ("imputation:imputer" in r["pipeline_steps_timing"]) == (r["prefix_hits"] == 0)
    append_run_log(out.select(*RUN_SCHEMA.names), str(tmp_path / "log"))
    log = read_run_log(spark, str(tmp_path / "log"))
    assert log.count() == 24 and mean_cost(log.withColumn("c", F.col("config").cast("string")), "c").count() == 8
    totals = cumulative_hits(out.withColumn("hits", F.col("prefix_hits")).withColumn("calls", F.lit(2)).drop("cache_hits", "total_evaluations"), ["stamp"], ["eval"])
    assert {(r["eval"], r["cache_hits"], r["total_evaluations"]) for r in totals.collect()} == {(r["eval"], r["cache_hits"], r["total_evaluations"]) for r in runs}


def test_instances_and_empty_folds(rows):
    some = trie.evaluate_trie(rows, CONFIGS[:1], 10, 3, instances=[1]).collect()
    every = trie.evaluate_trie(rows, CONFIGS[:1], 10, 3).collect()
    assert [r["cost"] for r in some] == [pytest.approx(r["cost"]) for r in every if r["instance"] == 1]


def test_class_weights(spark):
    rows = spark.createDataFrame([(i, int(i % 10 == 0), i % 2, [float(i)]) for i in range(100)], "row_id long, label int, fold int, features array<double>")
    view = trie.fit_balancing(trie.View(rows, 2, [0, 1]), {"strategy": "weighting"})
    assert view.weights[1] == pytest.approx({0: 2 * 10 / 50, 1: 2 * 40 / 50}) and view.weights[0] == {0: 1.0}
    assert trie.fit_balancing(trie.View(rows, 2, [0, 1]), {"strategy": "none"}).weights is None


def test_kept_columns_follow_the_tables(spark):
    rng = np.random.default_rng(3)
    for values in (rng.random(23), np.r_[rng.integers(0, 4, 20).astype(float), np.nan, np.nan]):
        scores = spark.createDataFrame([(i, float(v), float(v) / 4) for i, v in enumerate(values)], "pos int, score double, pvalue double")
        for percentile in (1.0, 10.0, 37.5, 50.0, 99.0, 100.0):
            assert sorted(r["pos"] for r in top_percentile(scores, percentile).collect()) == trie.kept_by_percentile(values, percentile).tolist()
        for mode in ("fpr", "fwe", "fdr"):
            clean = scores.filter("NOT isnan(score)")
            want = sorted(r["pos"] for r in by_rate(clean, 0.3, mode).collect())
            assert want == trie.kept_by_rate(values[~np.isnan(values)] / 4, 0.3, mode).tolist()
