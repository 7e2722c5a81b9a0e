"""Streaming forms: class moments and the incumbent of an append-only log.

Both are aggregates whose state is small (classes x columns, and one row per stamp).  Every
trigger rewrites the result table in the shared checkpoint folder, so a restarted query goes on
from its state and readers never see the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldwright.operators.moments import long_form, squared_deviations
from foldwright.session import scratch_path


def stream_table(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream.

    A pattern such as ``dir/name.parque[t]`` takes one table, be it a file or a folder of part files.
    """
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_available(aggregate: DataFrame, name: str, out: str | None = None, state: str | None = None) -> DataFrame:
    """Process everything available and return the result table."""
    spark = aggregate.sparkSession
    target = out or scratch_path(spark, name)

    def rewrite(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    query = (
        aggregate.writeStream.outputMode("complete")
        .foreachBatch(rewrite)
        .option("checkpointLocation", state or scratch_path(spark, f"{name}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # without any input no batch is run: the result is empty then
    spark.createDataFrame([], aggregate.schema).write.mode("ignore").parquet(target)
    return spark.read.schema(aggregate.schema).parquet(target)


def streaming_moments(rows: DataFrame, label: str, features: str) -> DataFrame:
    """n, sum and squared deviations per (class, column); the same numbers as the batch moments."""
    return (
        long_form(rows, [label], features)
        .groupBy(label, "pos")
        .agg(F.count("x").alias("n"), F.sum("x").alias("s"), squared_deviations("x").alias("m2"))
    )


def streaming_incumbent(log: DataFrame, stamp: str, config: str, cost: str, order: str) -> DataFrame:
    """Best configuration per stamp so far; the earlier run wins a tie."""
    return log.groupBy(stamp).agg(
        F.min_by(config, F.struct(cost, order)).alias("incumbent"), F.min(cost).alias("best_cost"), F.count(F.lit(1)).alias("evaluations")
    )
