"""Exact deduplication over an extendible-hash index kept in shared files (DataFrame operations only).

An index cell holds one 64-bit key and the chain of different texts that share it.  Cells live in buckets addressed by the
leading bits of the key; a bucket with more than ``capacity`` cells is split, which doubles the directory under it.  Owner
tasks hold contiguous key ranges of the index files.  Texts are compared by their bytes while grouping on (key, text), after
each task has merged its own copies, so a text that a third of all rows share is sent once per task.  This grouping alone decides
keep_id and group_size; rows find them by a join on (key, digest) that reads neither buckets nor directory.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import SPACE, store

CAPACITY = 20_000
MAX_DEPTH = 62


def normalized(text: Column | str) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " ")


def prefix(address: str, depth: int) -> Column:
    """The leading ``depth`` bits of an address."""
    return F.shiftrightunsigned(F.col(address), 64 - depth) if depth else F.lit(0).cast("bigint")


@dataclass
class ExtendibleIndex:
    """``cells`` (address, depth, chain), sorted by address in the files; ``directory`` (depth, prefix, cells)."""

    cells: DataFrame
    directory: DataFrame

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Join (address, digest) rows to their chain link: adds keep_id and group_size.

        Rows of a hot group all look for one cell; the join is a plain equi-join, so adaptive execution splits it.
        """
        links = self.cells.select("address", F.explode("chain").alias("link")).select(
            "address", F.col("link.digest").alias("digest"), F.col("link.keep_id").alias("keep_id"), F.col("link.group_size").alias("group_size")
        )
        return rows.join(links, ["address", "digest"], "left")


def _address(text: str) -> Column:
    return F.xxhash64(F.col(text))


def split_buckets(cells: DataFrame, capacity: int) -> tuple[DataFrame, int, int]:
    """Directory of local depths: (depth, prefix, cells), with its smallest and largest depth.

    The first depth gives buckets of about the capacity; then overfull ones are split again and again.  Only the number of
    overfull buckets reaches the driver.
    """
    total = cells.count()
    depth = first = max(0, math.ceil(math.log2(max(1, total / capacity))))
    directory = None
    pending = cells.select("address")
    while True:
        here = pending.groupBy(prefix("address", depth).alias("prefix")).agg(F.count(F.lit(1)).alias("cells"))
        here = store(here.select(F.lit(depth).alias("depth"), "prefix", "cells"), "directory")
        full = here.filter(F.col("cells") > capacity) if depth < MAX_DEPTH else here.limit(0)
        settled = here.filter(F.col("cells") <= capacity) if depth < MAX_DEPTH else here
        directory = settled if directory is None else directory.unionByName(settled)
        if full.isEmpty():
            return directory, first, depth
        pending = pending.withColumn("prefix", prefix("address", depth)).join(full.select("prefix"), "prefix", "left_semi").select("address")
        depth += 1


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> ExtendibleIndex:
    """Index all texts of (doc_id, text)."""
    texts = docs.select("doc_id", normalized("text").alias("body")).withColumn("address", _address("body"))
    same = texts.groupBy("address", "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    links = same.select("address", F.struct(F.sha2("body", 256).alias("digest"), "keep_id", "group_size").alias("link"))
    cells = store(links.groupBy("address").agg(F.array_sort(F.collect_list("link")).alias("chain")), "cells")
    directory, first, last = split_buckets(cells, capacity)
    depth = F.lit(None).cast("int")
    owned = cells
    for d in range(last, first - 1, -1):
        leaf = directory.filter(F.col("depth") == d).select(F.col("prefix").alias(f"p{d}"), F.lit(d).alias(f"d{d}"))
        owned = owned.withColumn(f"p{d}", prefix("address", d)).join(leaf, f"p{d}", "left")
        depth = F.coalesce(depth, F.col(f"d{d}"))
    owned = owned.select("address", depth.alias("depth"), "chain")
    parts = max(1, 2**first)
    return ExtendibleIndex(store(owned.repartitionByRange(parts, "address").sortWithinPartitions("address"), "index"), directory)


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space runs become one space; the row with the smallest doc_id stays.
    Null texts count as empty and form a group with the empty ones.  A null doc_id never becomes keep_id unless the whole
    group lacks ids; then keep_id is null and no row of it is kept.  Rows that repeat both id and text count in group_size
    and share one decision.  Other columns are ignored; an empty table gives an empty result.
    """
    index = build_index(docs, capacity)
    rows = docs.select("doc_id", normalized("text").alias("body")).select("doc_id", _address("body").alias("address"), F.sha2("body", 256).alias("digest"))
    return index.lookup(rows).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256")
    )
