"""Imputation and rescaling of arrays and of plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions.exprs import doubles, l1_normalize, l2_normalize
from foldwright.operators.moments import counts_mode, exact_median, long_form, missing, moments, value_counts
from foldwright.operators.steps import FeatureStep, RowMap, number_array
from foldwright.session import collect_bounded

MAX_COLUMNS = 100_000


def cells_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pos, x) of several numeric columns, missing cells left out."""
    e = F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("pos", "x")
    return df.select(e).filter(~missing(F.col("x")))


def fill_values(cells: DataFrame, strategy: str) -> DataFrame:
    """(pos, value): the replacement of missing cells per column."""
    if strategy == "mean":
        return cells.groupBy("pos").agg(F.avg("x").alias("value"))
    if strategy == "median":
        return exact_median(cells, ["pos"], "x").withColumnRenamed("median", "value")
    if strategy == "most_frequent":
        return counts_mode(value_counts(cells, ["pos"], "x"), ["pos"], "x").withColumnRenamed("mode", "value")
    raise ValueError(f"unknown strategy: {strategy}")


def _by_position(rows, field: str, width: int) -> list:
    out = [None] * width
    for r in rows:
        out[r["pos"]] = r[field]
    return out


def impute_columns(df: DataFrame, columns: list[str], strategy: str = "mean") -> DataFrame:
    """Replace NULL and NaN in the named columns; a column without any value stays missing."""
    rows = collect_bounded(fill_values(cells_of(df, columns), strategy), MAX_COLUMNS, "fill values")
    value = _by_position(rows, "value", len(columns))
    filled = {c: F.when(missing(F.col(c).cast("double")), F.lit(v)).otherwise(F.col(c).cast("double")) for c, v in zip(columns, value)}
    return df.withColumns(filled)


class Imputer(FeatureStep):
    """Mean, exact median or most frequent value per column of the feature array."""

    def __init__(self, strategy: str = "mean", **kw):
        super().__init__(**kw)
        self.strategy = strategy

    def _fit(self, dataset: DataFrame) -> RowMap:
        cells = long_form(dataset, [], self.features).filter(~missing(F.col("x")))
        rows = collect_bounded(fill_values(cells, self.strategy), MAX_COLUMNS, "fill values")
        width = max((r["pos"] for r in rows), default=-1) + 1
        fill = number_array(_by_position(rows, "value", width))
        return self._map(lambda a: F.transform(doubles(a), lambda x, i: F.when(missing(x), F.get(fill, i)).otherwise(x)))


def standard_params(df: DataFrame, features: str = "features") -> DataFrame:
    """(pos, mean, sd) with the population deviation; a constant column has sd 1."""
    m = moments(df, [], features)
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.col("m2") / F.col("n"))
    return m.select("pos", mean.alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("sd"))


class StandardScaler(FeatureStep):
    """(x - mean) / population deviation; without centring for sparse data."""

    def __init__(self, with_mean: bool = True, **kw):
        super().__init__(**kw)
        self.with_mean = with_mean

    def _fit(self, dataset: DataFrame) -> RowMap:
        rows = collect_bounded(standard_params(dataset, self.features), MAX_COLUMNS, "scaler parameters")
        mean = number_array(_by_position(rows, "mean", len(rows)) if self.with_mean else [0.0] * len(rows))
        sd = number_array(_by_position(rows, "sd", len(rows)))
        return self._map(lambda a: F.transform(doubles(a), lambda x, i: (x - F.get(mean, i)) / F.get(sd, i)))


def range_params(df: DataFrame, features: str = "features") -> DataFrame:
    return long_form(df, [], features).groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


class MinMaxScaler(FeatureStep):
    """(x - min) / (max - min); a constant column becomes 0."""

    def _fit(self, dataset: DataFrame) -> RowMap:
        rows = collect_bounded(range_params(dataset, self.features), MAX_COLUMNS, "scaler parameters")
        lo = _by_position(rows, "lo", len(rows))
        hi = _by_position(rows, "hi", len(rows))
        width = number_array([1.0 if a == b else b - a for a, b in zip(lo, hi)])
        low = number_array(lo)
        return self._map(lambda a: F.transform(doubles(a), lambda x, i: (x - F.get(low, i)) / F.get(width, i)))


class RowNormalizer(FeatureStep):
    """Unit l2 (or l1) norm per row; a zero row stays zero."""

    def __init__(self, norm: str = "l2", **kw):
        super().__init__(**kw)
        self.norm = norm

    def _fit(self, dataset: DataFrame) -> RowMap:
        fn = {"l1": l1_normalize, "l2": l2_normalize}[self.norm]
        return self._map(fn)


def scale_columns(df: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Standard or min-max scaling of plain columns from one aggregate row."""
    aggs: list[Column] = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        if how == "standard":
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
        elif how == "minmax":
            aggs += [F.min(x).alias(f"a{i}"), (F.max(x) - F.min(x)).alias(f"b{i}")]
        else:
            raise ValueError(f"unknown scaling: {how}")
    p = df.agg(*aggs).first()
    return df.withColumns(
        {c: (F.col(c).cast("double") - F.lit(p[f"a{i}"])) / F.lit(p[f"b{i}"] or 1.0) for i, c in enumerate(columns)}
    )
