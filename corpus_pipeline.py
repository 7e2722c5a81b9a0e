"""Corpus pipeline: language, exact copies, near copies, source mix, pieces.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and is written as Parquet before the next one
reads it.  All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import read, smaller_batches, store, vocabulary
from foldwright.llm.exact_dedup import exact_dedup, normalized
from foldwright.llm.language_id import keep_identified
from foldwright.llm.mixing import apply_mix
from foldwright.llm.near_dedup import near_dedup
from foldwright.llm.piece_codec import encode
from foldwright.session import ship_package

#: No SQL: the stages fit models, iterate and draw; tests hold them against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a main language, go."""
    ship_package(spark)
    smaller_batches(spark)
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, once; of a group without any id one row stays."""
    stay = exact_dedup(docs).filter("kept OR keep_id IS NULL").select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_digest"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.sha2(normalized("text"), 256).alias("digest"))
    same = F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("digest") == F.col("stay_digest"))
    return rows.join(stay, same, "left_semi").dropDuplicates(["own_id", "digest"]).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays; rows without doc_id link with nothing and stay."""
    smaller_batches(spark)
    gone = near_dedup(docs).filter("doc_id IS NOT NULL AND NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"))
    return rows.join(gone, F.col("own_id") == F.col("gone_id"), "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the entropy-balanced mix takes it."""
    return apply_mix(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and ids of every row, with merge-dropout."""
    ship_package(spark)
    smaller_batches(spark)
    encoded = encode(docs, vocabulary("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pieces", piece_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
