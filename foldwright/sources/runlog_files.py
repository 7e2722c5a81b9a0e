"""Run-log and trajectory files as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TEXT_MAP = T.MapType(T.StringType(), T.StringType())

RUN_SCHEMA = T.StructType(
    [
        T.StructField("stamp", T.StringType()),
        T.StructField("eval", T.LongType()),
        T.StructField("instance", T.IntegerType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("runtime", T.DoubleType()),
        T.StructField("pipeline_steps_timing", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("cache_hits", T.LongType()),
        T.StructField("total_evaluations", T.LongType()),
        T.StructField("runtime_reduction_by_caching", T.DoubleType()),
        T.StructField("wallclock_time", T.DoubleType()),
        T.StructField("config", _TEXT_MAP),
        T.StructField("config_origin", T.StringType()),
    ]
)

TRAJECTORY_SCHEMA = T.StructType(
    [
        T.StructField("stamp", T.StringType()),
        T.StructField("eval", T.LongType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("wallclock_time", T.DoubleType()),
        T.StructField("incumbent", _TEXT_MAP),
        T.StructField("config_origin", T.StringType()),
        T.StructField("test_performance", T.DoubleType()),
    ]
)


def append_run_log(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def write_trajectory(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).json(path)


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAJECTORY_SCHEMA).json(path)
