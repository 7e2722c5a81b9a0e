"""Row numbers and running totals in a given order, without one task per group.

A window over a whole group sends the group to one task.  Here the table is range-partitioned on
(group, order) instead, so a hot group spans many partitions.  Every partition computes its local
running value, and one carry per group that crosses a partition border is added.  There are at
most two such groups per partition, hence the carry table has at most ``2 * partitions`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.session import broadcast_checked, materialize

_PART = "_part"
_GROUP = "_group"


def _group_key(keys: list[str]) -> Column:
    """The group as one struct: never NULL itself, so groups with NULL keys join like any other."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))


@dataclass(frozen=True)
class Running:
    """One running measure: kind is ``count``, ``sum``, ``min`` or ``max``.

    ``exclusive`` leaves the current row out.
    """

    name: str
    kind: str
    column: str | None = None
    exclusive: bool = False


_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _aggregate(m: Running) -> Column:
    return F.count(F.lit(1)) if m.kind == "count" else _MERGE[m.kind](F.col(m.column))


def _combine(m: Running, carry: Column, local: Column) -> Column:
    if m.kind in ("count", "sum"):
        both = F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
        return both if m.kind == "count" else F.when(carry.isNotNull() | local.isNotNull(), both)
    pick = F.least if m.kind == "min" else F.greatest
    return pick(carry, local)  # both skip NULLs


def order_partitions(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Range-partition on (keys, order) and pin the partition number of every row.

    ``order`` must end in a unique column.  The result is checkpointed because the partition
    number is used by several passes that must agree.
    """
    columns = [*keys, *order]
    ranged = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    return materialize(ranged.withColumn(_PART, F.spark_partition_id()))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: list[Running],
    partitions: int | None = None,
) -> DataFrame:
    """Add running measures per group in the given order; exact for any group size."""
    kept = df.columns
    ordered = order_partitions(df, keys, order, partitions)
    n_parts = ordered.rdd.getNumPartitions() if partitions is None else partitions
    parts = ordered.withColumn(_GROUP, _group_key(keys))

    edges = (
        parts.groupBy(_PART)
        .agg(F.min(_GROUP).alias("lo"), F.max(_GROUP).alias("hi"))
        .select(_PART, F.explode(F.array_distinct(F.array("lo", "hi"))).alias(_GROUP))
    )
    totals = (
        parts.join(broadcast_checked(edges, 2 * n_parts), [_PART, _GROUP], "left_semi")
        .groupBy(_PART, _GROUP)
        .agg(*[_aggregate(m).alias(f"_t_{m.name}") for m in measures])
    )
    # rows here: at most two per partition
    before = Window.partitionBy(_GROUP).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        _PART, _GROUP, *[_MERGE[m.kind](f"_t_{m.name}").over(before).alias(f"_c_{m.name}") for m in measures]
    )

    local = Window.partitionBy(_PART, _GROUP).orderBy(*order)
    values = []
    for m in measures:
        frame = local.rowsBetween(Window.unboundedPreceding, -1 if m.exclusive else Window.currentRow)
        values.append(_aggregate(m).over(frame).alias(f"_l_{m.name}"))
    return (
        parts.select("*", *values)
        .join(broadcast_checked(carries, 2 * n_parts), [_PART, _GROUP], "left")
        .select(*kept, *[_combine(m, F.col(f"_c_{m.name}"), F.col(f"_l_{m.name}")).alias(m.name) for m in measures])
    )


def hash_rank(df: DataFrame, keys: list[str], id_col: str, name: str = "rank", salt: str = "") -> DataFrame:
    """1-based rank inside each group in the order of md5(id), id.

    The first three hex digits of the hash split a group into 4096 even pieces; a piece is ranked
    in one task and shifted by the size of the pieces before it.  Equals
    ``row_number() over (partition by keys order by md5(id), id)``.
    """
    h = F.md5(F.concat(F.lit(salt), F.col(id_col).cast("string")) if salt else F.col(id_col).cast("string"))
    kept = df.columns
    pieces = df.withColumns({_GROUP: _group_key(keys), "_h": h}).withColumn("_piece", F.substring("_h", 1, 3))
    sizes = df.select(_group_key(keys).alias(_GROUP), F.substring(h, 1, 3).alias("_piece")).groupBy(_GROUP, "_piece").count()
    before = Window.partitionBy(_GROUP).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_GROUP, "_piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(_GROUP, "_piece").orderBy("_h", id_col)
    return (
        pieces.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [_GROUP, "_piece"])
        .select(*kept, (F.col("_rn") + F.col("_offset")).alias(name))
    )
