"""Feature selection: univariate scores, score thresholds, and model importances."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.exprs import clip_nonnegative, doubles
from foldwright.functions.special import chi2_pvalue, f_pvalue
from foldwright.operators.moments import moments
from foldwright.operators.steps import FeatureStep, RowMap, pick
from foldwright.session import collect_bounded

MAX_COLUMNS = 100_000


def chi2_scores(df: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """(pos, score, pvalue): observed per-class sums against class share x column total."""
    return chi2_from_moments(moments(df.withColumn(features, clip_nonnegative(doubles(features))), [label], features))


def chi2_from_moments(stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., pos, score, pvalue) from the moments of every class and column."""
    at = [*(keys or []), "pos"]
    column = stats.groupBy(*at).agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    expected = F.col("n") / F.col("_n") * F.col("_s")
    gap = F.col("s") - expected
    scored = stats.join(column, at).groupBy(*at, "_k").agg(F.sum(F.when(expected != 0, gap * gap / expected)).alias("score"))
    return scored.select(*at, "score", chi2_pvalue(F.coalesce(F.col("score"), F.lit(float("nan"))), F.col("_k") - 1).alias("pvalue"))


def f_scores(df: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """(pos, score, pvalue): between-class over within-class mean square."""
    return f_from_moments(moments(df, [label], features))


def f_from_moments(stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., pos, score, pvalue) from the moments of every class and column."""
    at = [*(keys or []), "pos"]
    centre = stats.groupBy(*at).agg((F.sum("s") / F.sum("n")).alias("_mean"))
    off = F.col("s") / F.col("n") - F.col("_mean")
    column = stats.join(centre, at).groupBy(*at).agg(
        F.sum("m2").alias("_within"),
        F.sum(F.col("n") * off * off).alias("_between"),
        F.sum("n").alias("_n"),
        F.count(F.lit(1)).alias("_k"),
    )
    d1, d2 = F.col("_k") - 1, F.col("_n") - F.col("_k")
    score = F.when(F.col("_within") > 0, (F.col("_between") / d1) / (F.col("_within") / d2))
    s = F.coalesce(score, F.lit(float("nan")))
    return column.select(*at, score.alias("score"), f_pvalue(s, d1.cast("double"), d2.cast("double")).alias("pvalue"))


SCORES = {"chi2": chi2_scores, "f_classif": f_scores}
_LOWEST = -1.7976931348623157e308


def top_percentile(scores: DataFrame, percentile: float) -> DataFrame:
    """Rows above the (100 - percentile) quantile, then ties in column order up to the quota.

    ``scores`` has one row per feature column.
    """
    clean = scores.withColumn("_v", F.coalesce(F.nanvl("score", F.lit(None).cast("double")), F.lit(_LOWEST)))
    if percentile >= 100:
        return clean.drop("_v")
    cut = clean.agg(F.percentile("_v", 1.0 - percentile / 100.0)).scalar()
    quota = F.floor(clean.agg(F.count(F.lit(1))).scalar() * percentile / 100.0)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("_v").desc(), "pos")
    ranked = clean.withColumn("_cut", cut).withColumn("_quota", quota).withColumn("_rank", F.row_number().over(order))
    keep = (F.col("_v") > F.col("_cut")) | ((F.col("_v") == F.col("_cut")) & (F.col("_rank") <= F.col("_quota")))
    return ranked.filter(keep).drop("_v", "_cut", "_quota", "_rank")


def by_rate(scores: DataFrame, alpha: float, mode: str = "fpr") -> DataFrame:
    """Rows passing a false-positive (fpr), family-wise (fwe) or false-discovery (fdr) level."""
    if mode == "fpr":
        return scores.filter(F.col("pvalue") < alpha)
    d = scores.agg(F.count(F.lit(1))).scalar()
    if mode == "fwe":
        return scores.withColumn("_d", d).filter(F.col("pvalue") < F.lit(alpha) / F.col("_d")).drop("_d")
    if mode == "fdr":
        order = Window.partitionBy(F.lit(0)).orderBy(F.col("pvalue").asc_nulls_last(), "pos")
        ranked = scores.withColumn("_d", d).withColumn("_i", F.row_number().over(order))
        passing = ranked.withColumn("_ok", F.when(F.col("pvalue") <= F.lit(alpha) * F.col("_i") / F.col("_d"), F.col("pvalue")))
        limit = passing.withColumn("_limit", F.max("_ok").over(Window.partitionBy(F.lit(0))))
        return limit.filter(F.col("pvalue") <= F.col("_limit")).drop("_d", "_i", "_ok", "_limit")
    raise ValueError(f"unknown mode: {mode}")


def above_mean(importances: DataFrame) -> DataFrame:
    """(pos, importance) rows with importance >= mean importance."""
    mean = importances.agg(F.avg("importance")).scalar()
    return importances.withColumn("_m", mean).filter(F.col("importance") >= F.col("_m")).drop("_m")


class _Selector(FeatureStep):
    def _keep(self, kept: DataFrame) -> RowMap:
        positions = sorted(r["pos"] for r in collect_bounded(kept.select("pos"), MAX_COLUMNS, "selected columns"))
        if not positions:
            raise ValueError("every feature was removed")
        return self._map(pick(positions), positions=positions)


class SelectPercentile(_Selector):
    def __init__(self, percentile: float = 50.0, score_func: str = "chi2", **kw):
        super().__init__(**kw)
        self.percentile, self.score_func = float(percentile), score_func

    def _fit(self, dataset: DataFrame) -> RowMap:
        scores = SCORES[self.score_func](dataset, self.label, self.features)
        return self._keep(top_percentile(scores, self.percentile))


class SelectRates(_Selector):
    """The ``mode`` is honoured here; the default is fpr."""

    def __init__(self, alpha: float = 0.1, score_func: str = "chi2", mode: str = "fpr", **kw):
        super().__init__(**kw)
        self.alpha, self.score_func, self.mode = float(alpha), score_func, mode

    def _fit(self, dataset: DataFrame) -> RowMap:
        scores = SCORES[self.score_func](dataset, self.label, self.features)
        return self._keep(by_rate(scores, self.alpha, self.mode))


def features_per_split(max_features: float, width: int) -> int:
    """int(f * (ln d + 1)), at least one and at most half of the columns."""
    return max(1, min(width // 2, int(float(max_features) * (math.log(width) + 1))))


def width_of(df: DataFrame, features: str) -> int:
    row = df.select(F.size(features).alias("d")).first()
    if row is None:
        raise ValueError("no rows to fit on")
    return row["d"]


def with_vector(df: DataFrame, features: str, name: str = "_vec") -> DataFrame:
    return df.withColumn(name, array_to_vector(doubles(features)))


def importance_table(df: DataFrame, values) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "pos int, importance double")


class TreeSelect(_Selector):
    """Columns whose forest importance is at least the mean."""

    def __init__(self, n_estimators: int = 100, criterion: str = "gini", max_features: float = 1.0,
                 min_samples_split: int = 2, min_samples_leaf: int = 1, bootstrap: bool = False,
                 max_depth: int = 10, seed: int = 1, **kw):
        super().__init__(**kw)
        self.forest = dict(numTrees=int(n_estimators), impurity=criterion, minInstancesPerNode=max(int(min_samples_leaf), math.ceil(int(min_samples_split) / 2)),
                           bootstrap=bootstrap, maxDepth=max_depth, seed=seed)
        self.max_features = max_features

    def importances(self, dataset: DataFrame) -> DataFrame:
        d = width_of(dataset, self.features)
        forest = RandomForestClassifier(
            featuresCol="_vec", labelCol=self.label, featureSubsetStrategy=str(features_per_split(self.max_features, d)), **self.forest
        )
        model = forest.fit(with_vector(dataset, self.features))
        return importance_table(dataset, model.featureImportances.toArray())

    def _fit(self, dataset: DataFrame) -> RowMap:
        return self._keep(above_mean(self.importances(dataset)))


class LinearSelect(_Selector):
    """Columns whose summed |coefficient| over the classes is at least the mean, from an l1 (or l2) squared-hinge SVM."""

    def __init__(self, C: float = 1.0, tol: float = 1e-4, loss: str = "squared_hinge", penalty: str = "l1", max_iter: int = 100, **kw):
        super().__init__(**kw)
        if loss != "squared_hinge" or penalty not in ("l1", "l2"):
            raise ValueError("only the squared hinge with l1 or l2 penalty is allowed")
        self.C, self.tol, self.penalty, self.max_iter = float(C), float(tol), penalty, max_iter

    def importances(self, dataset: DataFrame) -> DataFrame:
        from foldwright.operators.linear import LinearSVM, class_values

        estimator = LinearSVM(self.C, self.tol, self.penalty, max_iter=self.max_iter, label=self.label, features=self.features)
        w = estimator.weights(dataset, class_values(dataset, self.label))
        return importance_table(dataset, np.abs(w[:, :-1]).sum(axis=0))

    def _fit(self, dataset: DataFrame) -> RowMap:
        return self._keep(above_mean(self.importances(dataset)))
