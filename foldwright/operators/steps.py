"""Base of the feature steps: estimators that turn one feature array into another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RowMap(Transformer):
    """A fitted step: one array expression per row, no shuffle."""

    def __init__(self, expression: Callable[[Column], Column], features: str = "features", info: dict | None = None):
        super().__init__()
        self.expression = expression
        self.features = features
        self.info = info or {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.features, self.expression(F.col(self.features)))


class FeatureStep(Estimator):
    """Subclasses implement ``_fit`` and return a :class:`RowMap`."""

    def __init__(self, features: str = "features", label: str = "label", row_id: str = "row_id"):
        super().__init__()
        self.features, self.label, self.row_id = features, label, row_id

    def _map(self, expression: Callable[[Column], Column], **info) -> RowMap:
        return RowMap(expression, self.features, info)


class Identity(FeatureStep):
    """No rescaling, no preprocessing, no balancing."""

    def _fit(self, dataset: DataFrame) -> RowMap:
        return self._map(lambda a: a)


def number_array(values) -> Column:
    """A literal array<double>; missing numbers become NULL."""
    return F.array(*[F.lit(None if v is None else float(v)) for v in values]).cast("array<double>")


def pick(positions: list[int]) -> Callable[[Column], Column]:
    """Keep the given positions, in the given order."""
    index = F.array(*[F.lit(int(p)) for p in positions]).cast("array<int>")
    return lambda a: F.transform(index, lambda i: F.get(a, i))
