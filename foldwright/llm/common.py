"""Tables, stored intermediates and batch helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.session import scratch_path, ship_package

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a frame under the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables written by :func:`store` that no later plan reads."""
    for df in frames:
        files = df.inputFiles()
        if files:
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner delete shuffle files of plans that are done; otherwise they stay until the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(doc_id: Column | str, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % divisor


def text_ranges(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """(start, stop, texts) of slices of about ``size`` bytes, cut before any text becomes a Python string.

    A text longer than that is a slice of its own; a null text counts as empty.
    """
    reach = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(reach[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(reach, before + size, side="right")))
        yield start, stop, [t or "" for t in texts.slice(start, stop - start).to_pylist()]
        start = stop


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches in the slices of :func:`text_ranges`, so that memory follows the slice and not the batch.

    What a batch leaves unused goes back to the system: workers are kept between stages, and several idle ones stand beside a task.
    """
    for batch in batches:
        for start, stop, texts in text_ranges(batch.column(batch.schema.get_field_index(column)), size):
            yield batch.slice(start, stop - start), texts
        release_memory()


def release_memory() -> None:
    """Give free memory of Arrow's pool and of the C library back to the system, where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def smaller_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Arrow batches of the session hold at most ``rows`` rows: long texts are buffered once per task in the JVM and its worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


#: DuckDB expression of the crc32 of a BIGINT's decimal digits; ``{}`` stands for it.
SQL_CRC32 = (
    "xor(list_reduce([4294967295::BIGINT] || flatten([[ord(c), 0, 0, 0, 0, 0, 0, 0]::BIGINT[] FOR c IN string_split({}::VARCHAR, '')]), "
    "lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
)
