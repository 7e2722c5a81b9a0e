"""Balanced accuracy over prediction tables; all groups are scored in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions.constants import COUNT_FLOOR


def _floor(c: Column) -> Column:
    return F.greatest(c.cast("double"), F.lit(COUNT_FLOOR))


def _rate(hit: Column, miss: Column) -> Column:
    """hit / (hit + miss); the floor applies to the hits before the sum."""
    return _floor(hit) / _floor(_floor(hit) + miss)


def _count(cond: Column) -> Column:
    return F.sum(cond.cast("bigint"))


def confusion_counts(df: DataFrame, truth: str, decision: str, keys: list[str]) -> DataFrame:
    """tp, fp, tn, fn of 0/1 columns per group."""
    y, p = F.col(truth) == 1, F.col(decision) == 1
    return df.groupBy(*keys).agg(
        _count(y & p).alias("tp"), _count(~y & p).alias("fp"), _count(~y & ~p).alias("tn"), _count(y & ~p).alias("fn")
    )


def bac_binary(df: DataFrame, truth: str, score: str, keys: list[str]) -> DataFrame:
    """0.5 * (TPR + TNR); the score is cut at 0.5."""
    decided = df.withColumn("_d", (F.col(score) >= 0.5).cast("int"))
    c = confusion_counts(decided, truth, "_d", keys)
    bac = 0.5 * (_rate(F.col("tp"), F.col("fn")) + _rate(F.col("tn"), F.col("fp")))
    return c.select(*keys, bac.alias("bac"))


def class_confusion(df: DataFrame, truth: str, decision: str, keys: list[str]) -> DataFrame:
    """tp, fp, tn, fn per group and class.

    Only the (truth, decision) pair counts are shuffled; the per-class totals come from them.
    """
    pairs = df.groupBy(*keys, truth, decision).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        *keys,
        "n",
        F.explode(
            F.when(F.col(truth) == F.col(decision), F.array(F.struct(F.col(truth).alias("c"), F.lit("tp").alias("side"))))
            .otherwise(
                F.array(
                    F.struct(F.col(truth).alias("c"), F.lit("fn").alias("side")),
                    F.struct(F.col(decision).alias("c"), F.lit("fp").alias("side")),
                )
            )
        ).alias("e"),
    )
    per_class = sides.groupBy(*keys, F.col("e.c").alias("class")).agg(
        *[F.coalesce(F.sum(F.when(F.col("e.side") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("tp", "fp", "fn")]
    )
    if keys:
        joined = per_class.join(pairs.groupBy(*keys).agg(F.sum("n").alias("_all")), keys)
    else:
        joined = per_class.withColumn("_all", pairs.agg(F.sum("n")).scalar())
    return joined.withColumn("tn", F.col("_all") - F.col("tp") - F.col("fp") - F.col("fn")).drop("_all")


def bac_multiclass(df: DataFrame, truth: str, decision: str, k: int, keys: list[str]) -> DataFrame:
    """Mean recall over all k classes; a class without true rows counts as recall 1.

    A label or decision outside 0..k-1 is an error.
    """
    t, d = F.col(truth), F.col(decision)
    bad = (t < 0) | (t >= k) | (d < 0) | (d >= k)
    hit = F.when(bad, F.raise_error(F.lit(f"class outside 0..{k - 1}")).cast("boolean")).otherwise(t == d)
    per_class = df.groupBy(*keys, truth).agg(_count(hit).alias("tp"), F.count(F.lit(1)).alias("pos"))
    recall = _rate(F.col("tp"), F.col("pos") - F.col("tp"))
    bac = (F.sum(recall) + (F.lit(k) - F.count(F.lit(1)))) / F.lit(float(k))
    return per_class.groupBy(*keys).agg(bac.alias("bac"))


def bac_multilabel(df: DataFrame, truth: str, score: str, keys: list[str]) -> DataFrame:
    """Binary formula per label column of two arrays, then the mean over the columns."""
    size_ok = F.when(F.size(truth) == F.size(score), F.arrays_zip(F.col(truth).alias("y"), F.col(score).alias("p"))).otherwise(
        F.raise_error(F.lit("truth and score arrays differ in length")).cast("array<struct<y:int,p:double>>")
    )
    long = df.select(*keys, F.posexplode(size_ok).alias("pos", "e")).select(
        *keys, "pos", F.col("e.y").alias("_y"), F.col("e.p").alias("_p")
    )
    return bac_binary(long, "_y", "_p", [*keys, "pos"]).groupBy(*keys).agg(F.avg("bac").alias("bac"))


def cost(bac: Column | str) -> Column:
    return F.lit(1.0) - (F.col(bac) if isinstance(bac, str) else bac)
