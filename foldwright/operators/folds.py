"""Row subsets: stratified folds, index splits and leading rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.operators.ordered import hash_rank

DEFAULT_FOLDS = 2


def stratified_folds(df: DataFrame, k: int = DEFAULT_FOLDS, label: str = "label", row_id: str = "row_id", salt: str = "") -> DataFrame:
    """Add ``fold`` in 0..k-1; every class is spread over the folds to within one row."""
    ranked = hash_rank(df, [label], row_id, "_rank", salt)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def fold_split(df: DataFrame, instance: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(train, held out) for an instance number; one past the last fold means the last fold."""
    held = min(instance, k - 1)
    return df.filter(F.col("fold") != held), df.filter(F.col("fold") == held)


def downsample(df: DataFrame, n: int | None, row_id: str = "row_id") -> DataFrame:
    """The first n rows in file order."""
    return df if not n else df.filter(F.col(row_id) < n)


def split_by_index(df: DataFrame, test_index: DataFrame, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(train, test) by a table of test row ids."""
    return df.join(test_index, row_id, "left_anti"), df.join(test_index, row_id, "left_semi")
