"""One-hot encoding with a minimum fraction for a category to get its own column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.constants import CODE_MISSING, CODE_OTHER, CODE_SHIFT
from foldwright.operators.moments import missing
from foldwright.operators.ordered import Running, running
from foldwright.session import broadcast_checked, collect_bounded


def _raw_code(column: str) -> Column:
    v = F.col(column).cast("double")
    return (
        F.when(missing(v), F.lit(CODE_MISSING))
        .when(v < 0, F.raise_error(F.lit("categories must be non-negative integers")).cast("bigint"))
        .otherwise(v.cast("bigint") + CODE_SHIFT)
        .cast("bigint")
    )


@dataclass
class OneHotModel:
    """``dictionary`` is (col, code, out): the output column of every code kept in the fit."""

    columns: list[str]
    dictionary: DataFrame
    other: dict[int, int]
    widths: dict[int, int]
    minimum_fraction: float | None

    @property
    def width(self) -> int:
        return sum(self.widths.values())

    def transform(self, df: DataFrame, name: str = "active") -> DataFrame:
        """Add the sorted array of active output columns.

        Each input column is one left join with its own part of the dictionary.  With a minimum
        fraction a part has at most 1/fraction + 2 rows and is broadcast; without one the part may
        be large, and only parts below the broadcast limit are hinted.
        """
        out = df
        for i, c in enumerate(self.columns):
            part = self.dictionary.filter(F.col("col") == i).select(F.col("code").alias(f"_k{i}"), F.col("out").alias(f"_o{i}"))
            out = out.withColumn(f"_k{i}", _raw_code(c)).join(broadcast_checked(part, self.widths.get(i, 0)), f"_k{i}", "left")
        found = [
            F.coalesce(F.col(f"_o{i}"), F.lit(self.other.get(i)).cast("int")) if self.minimum_fraction is not None else F.col(f"_o{i}")
            for i in range(len(self.columns))
        ]
        drop = [f"_{p}{i}" for i in range(len(self.columns)) for p in "ko"]
        return out.withColumn(name, F.array_sort(F.array_compact(F.array(*found)))).drop(*drop)

    def dense(self, active: Column | str) -> Column:
        a = F.col(active) if isinstance(active, str) else active
        return F.transform(F.sequence(F.lit(0), F.lit(self.width - 1)), lambda i: F.array_contains(a, i).cast("double"))


def fit_one_hot(df: DataFrame, columns: list[str], minimum_fraction: float | None = 0.01) -> OneHotModel:
    """Codes per column: missing 2, rare 1, else value + 3; output columns by (column, code)."""
    cells = df.select(F.posexplode(F.array(*[_raw_code(c) for c in columns])).alias("col", "raw"))
    counts = cells.groupBy("col", "raw").agg(F.count(F.lit(1)).alias("cnt"))
    if minimum_fraction is None:
        codes = counts.select("col", F.col("raw").alias("code"))
        numbered = running(codes, [], ["col", "code"], [Running("rank", "count")])
        dictionary = numbered.select("col", "code", (F.col("rank") - 1).cast("int").alias("out"))
    else:
        total = counts.groupBy("col").agg(F.sum("cnt").alias("_total"))
        kept = F.when(F.col("cnt") / F.col("_total") >= minimum_fraction, F.col("raw")).otherwise(F.lit(CODE_OTHER))
        codes = counts.join(total, "col").select("col", kept.alias("code")).distinct()
        # at most 1/fraction + 2 codes per column
        order = Window.partitionBy(F.lit(0)).orderBy("col", "code")
        dictionary = codes.select("col", "code", (F.row_number().over(order) - 1).cast("int").alias("out"))
    dictionary = dictionary.persist()
    summary = dictionary.groupBy("col").agg(
        F.count(F.lit(1)).alias("width"), F.max(F.when(F.col("code") == CODE_OTHER, F.col("out"))).alias("other")
    )
    rows = collect_bounded(summary, len(columns), "one-hot columns")
    return OneHotModel(
        columns,
        dictionary,
        {r["col"]: r["other"] for r in rows if r["other"] is not None},
        {r["col"]: r["width"] for r in rows},
        minimum_fraction,
    )
