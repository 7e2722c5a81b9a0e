"""Readers of dataset folders: info files, dense, sparse and binary-sparse matrices, labels.

A folder ``<name>/`` holds ``<name>_public.info``, ``<name>_{train,valid,test}.data`` and
``.solution`` and, optionally, ``<name>_feat.type``.  Rows are identified by their position.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.functions.exprs import class_index, metric_code, parse_number, task_code

SPLITS = ("train", "valid", "test")


# ---------------------------------------------------------------- lines with their position

def read_lines(spark: SparkSession, path: str | list[str], skip: Column | None = None, group: Column | None = None) -> DataFrame:
    """(file, row_id, value): text lines numbered from 0 per file in file order.

    With ``group``, an expression over ``file``, the numbers go on over the files of a group in the
    order of their names (the part files of one table).

    A file may be read as many splits.  Lines are counted per split, and a line's number is its
    place in the split plus the lines of the splits before it, so no file passes through one task.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), "value"
    )
    if skip is not None:
        raw = raw.filter(~skip)
    tagged = raw.withColumn("_mid", F.monotonically_increasing_id())
    # one row per split: at most the table size over the split size
    splits = tagged.groupBy("file", "_start").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.col("file") if group is None else group).orderBy("file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return tagged.join(offsets, ["file", "_start"]).select(
        "file", (F.col("_mid") - F.col("_first") + F.col("_offset")).alias("row_id"), "value"
    )


def _tokens(value: Column) -> Column:
    return F.filter(F.split(F.trim(value), r"\s+"), lambda t: t != "")


# ---------------------------------------------------------------- matrices

def parse_dense(value: Column, n: int) -> Column:
    """The first n numbers of a line; a shorter line is an error."""
    parts = _tokens(value)
    short = F.raise_error(F.concat(F.lit("line has fewer columns than declared: "), F.size(parts).cast("string"))).cast("array<float>")
    return F.when(F.size(parts) < n, short).otherwise(F.slice(parts, 1, n).cast("array<float>"))


def parse_sparse(value: Column) -> Column:
    """``idx:val`` tokens (1-based) to a map of 0-based index to value; the last of repeated indexes wins."""
    pairs = F.transform(
        _tokens(value),
        lambda t: F.struct((F.split(t, ":")[0].cast("int") - 1).alias("key"), F.split(t, ":")[1].cast("float").alias("value")),
    )
    index = F.transform(pairs, lambda p: p["key"])
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(index, i + 2, F.size(index)), p["key"]))
    return F.when(F.size(F.array_distinct(index)) == F.size(index), F.map_from_entries(pairs)).otherwise(F.map_from_entries(last))


def parse_binary_sparse(value: Column) -> Column:
    """Active 1-based columns to a sorted array of 0-based columns."""
    return F.array_sort(F.array_distinct(F.transform(_tokens(value), lambda t: t.cast("int") - 1)))


def read_dense(spark: SparkSession, path, n: int, group: Column | None = None) -> DataFrame:
    comment_or_blank = F.col("value").rlike("^%") | F.col("value").rlike(r"^\s*$")
    return read_lines(spark, path, comment_or_blank, group).select("file", "row_id", parse_dense(F.col("value"), n).alias("features"))


def read_sparse(spark: SparkSession, path, group: Column | None = None) -> DataFrame:
    return read_lines(spark, path, group=group).select("file", "row_id", parse_sparse(F.col("value")).alias("cells"))


def read_binary_sparse(spark: SparkSession, path, group: Column | None = None) -> DataFrame:
    return read_lines(spark, path, group=group).select("file", "row_id", parse_binary_sparse(F.col("value")).alias("active"))


def densify(cells: Column | str, n: int) -> Column:
    """Map of index to value, to an array of n numbers."""
    c = F.col(cells) if isinstance(cells, str) else cells
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at(c, i), F.lit(0.0).cast("float")))


def densify_binary(active: Column | str, n: int) -> Column:
    a = F.col(active) if isinstance(active, str) else active
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(a, i).cast("float"))


def detect_format(lines: DataFrame, is_sparse: int | None = None) -> DataFrame:
    """One row ``format`` per file: dense, sparse or sparse_binary, from one aggregate over the lines."""
    parts = _tokens(F.col("value"))
    facts = lines.groupBy("file").agg(
        F.coalesce(F.min_by(F.contains(F.get(parts, F.lit(0)), F.lit(":")), "row_id"), F.lit(False)).alias("_pairs"),
        (F.min(F.size(parts)) != F.max(F.size(parts))).alias("_ragged"),
    )
    if is_sparse == 0:
        kind = F.lit("dense")
    elif is_sparse is not None:
        kind = F.when(F.col("_pairs"), "sparse").otherwise("sparse_binary")
    else:
        kind = F.when(F.col("_pairs"), "sparse").when(F.col("_ragged"), "sparse_binary").otherwise("dense")
    return facts.select("file", kind.alias("format"))


# ---------------------------------------------------------------- info, types, labels

def _dataset_of(file: Column, suffix: str) -> Column:
    return F.regexp_extract(file, r"([^/]+)" + suffix + "$", 1)


def read_info(spark: SparkSession, glob: str, from_folder: bool = False) -> DataFrame:
    """One row per dataset: name, info map, task and metric codes.  No file at all is an error.

    With ``from_folder`` the dataset is named by the folder of the file instead of the file.
    """
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(path, r"([^/=]+)_public\.info", 1) if from_folder else _dataset_of(path, r"_public\.info(/[^/]*)?")
    return _parsed_info(spark.read.text(glob).select(name.alias("name"), "value"))


def write_packed_info(infos: DataFrame, path: str) -> None:
    """Many info files, given as (file, value), as text lines ``file<TAB>line``: a folder each would cost more than its few lines."""
    lines = infos.select(F.coalesce("file", F.lit("")).alias("file"), F.explode(F.split("value", "\n")).alias("line"))
    lines.select(F.concat_ws("\t", "file", "line").alias("value")).write.text(path)


def read_packed_info(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`read_info` from lines ``file<TAB>line``."""
    part = F.split("value", "\t", 2)
    return _parsed_info(spark.read.text(path).select(_dataset_of(part[0], r"_public\.info").alias("name"), part[1].alias("value")))


def _parsed_info(lines: DataFrame) -> DataFrame:
    """One row per dataset from the lines (name, value) of its info file."""
    pair = F.split("value", " = ", 2)
    clean = F.trim(F.regexp_replace(F.rtrim(pair[1]), "^'+|'+$", ""))
    entries = lines.filter(F.size(pair) == 2).select("name", F.trim(F.regexp_replace(pair[0], "^'+", "")).alias("key"), clean.alias("value"))
    # an info file has a few dozen lines
    info = entries.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("info"))
    return info.select(
        "name",
        "info",
        task_code(F.col("info")["task"]).alias("task"),
        metric_code(F.col("info")["metric"]).alias("metric"),
        parse_number(F.col("info")["feat_num"]).alias("feat_num"),
        parse_number(F.col("info")["label_num"]).alias("label_num"),
        parse_number(F.col("info")["is_sparse"]).alias("is_sparse"),
    )


def read_feature_types(spark: SparkSession, info: DataFrame, glob: str | None = None) -> DataFrame:
    """(name, types): the type file where there is one, else the declared type for every column."""
    declared = info.select("name", F.array_repeat(F.col("info")["feat_type"], F.col("feat_num").cast("int")).alias("_declared"))
    if glob is None:
        return declared.select("name", F.col("_declared").alias("types"))
    # one line per column of a dataset
    rows = read_lines(spark, glob).select(_dataset_of(F.col("file"), r"_feat\.type").alias("name"), "row_id", F.explode(_tokens(F.col("value"))).alias("t"))
    listed = rows.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "t"))), lambda e: e["t"]).alias("_listed"))
    return declared.join(listed, "name", "left").select("name", F.coalesce("_listed", "_declared").alias("types"))


def parse_label(value: Column, task: str) -> Column:
    """Multilabel rows stay arrays; multiclass indicator rows become a class; others are one number."""
    parts = _tokens(value)
    if task == "multilabel.classification":
        return parts.cast("array<int>")
    if task == "multiclass.classification":
        return class_index(parts)
    return parts[0].cast("double")


def read_labels(spark: SparkSession, path, task: str, group: Column | None = None) -> DataFrame:
    return read_lines(spark, path, F.col("value").rlike(r"^\s*$"), group).select("file", "row_id", parse_label(F.col("value"), task).alias("label"))


def load_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """(split, row_id, features, label): matrices and labels joined on (split, position)."""
    folder = folder.rstrip("/")
    name = os.path.basename(folder)
    info = read_info(spark, f"{folder}/{name}_public.info").first()
    if info is None:
        raise ValueError(f"no info file for {name}")
    n, task = int(info["feat_num"]), info["info"]["task"]
    data = [f"{folder}/{name}_{s}.data" for s in SPLITS]
    labels = [f"{folder}/{name}_{s}.solution" for s in SPLITS]
    split = lambda ext: F.regexp_extract("file", r"_(train|valid|test)\." + ext + "(/|$)", 1)
    group = split("data")
    if info["is_sparse"] == 0:
        x = read_dense(spark, data, n, group)
    else:
        lines = read_lines(spark, data[0])
        kind = detect_format(lines, info["is_sparse"]).first()["format"]
        if kind == "sparse":
            x = read_sparse(spark, data, group).select("file", "row_id", densify("cells", n).alias("features"))
        elif kind == "sparse_binary":
            x = read_binary_sparse(spark, data, group).select("file", "row_id", densify_binary("active", n).alias("features"))
        else:
            x = read_dense(spark, data, n, group)
    x = x.select(split("data").alias("split"), "row_id", "features")
    y = read_labels(spark, labels, task, split("solution")).select(split("solution").alias("split"), "row_id", "label")
    return x.join(y, ["split", "row_id"])
