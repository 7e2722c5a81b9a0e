"""Registry of queries and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, features, label) from the embeddings."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), "label"
    )


def item_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, features, label) from the line items: four measures, return flag as class 0..2."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"),
        flag.cast("int").alias("label"),
        "l_linestatus",
    )


def shifted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, features, label): line items with a large mean and a spread of about one."""
    items = item_matrix(spark, sf_dir)
    line = F.col("row_id") % 10
    far = F.array((line % 3 + F.col("label") * 2 + 1_700_000_000).cast("double"), (line * 0.25 + 1_700_000_000).cast("double"))
    return items.withColumn("features", far)


SHIFTED_CELLS = """
item AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, l_linenumber AS line FROM lineitem),
cells AS (SELECT row_id, label, unnest([0, 1]) AS pos,
                 unnest([CAST(line % 3 + label * 2 + 1700000000 AS DOUBLE), CAST(line AS DOUBLE) * 0.25 + 1700000000]) AS x FROM item)
"""


def r(c, digits: int = 6):
    """Rounded double; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)
