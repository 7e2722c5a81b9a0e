"""Array columns as numpy matrices inside Arrow-batched column functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_matrix(values: pa.Array) -> np.ndarray:
    """(rows, width) float64 view of a list array whose rows all have the same width."""
    n = len(values)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if n and flat.size % n:
        raise ValueError("rows of a feature matrix must have one width")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def to_lists(matrix: np.ndarray) -> pa.Array:
    n = matrix.shape[0]
    width = matrix.shape[1] if n else 0
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel()))


def map_matrix(fn: Callable[[np.ndarray], np.ndarray], features: Column | str) -> Column:
    """Apply a matrix-to-matrix function to an array column, one Arrow batch at a time."""

    @F.arrow_udf("array<double>")
    def run(values: pa.Array) -> pa.Array:
        return to_lists(fn(to_matrix(values)))

    return run(features)


def map_matrix_by(fns: dict[int, Callable[[np.ndarray], np.ndarray]], group: Column | str, features: Column | str) -> Column:
    """As :func:`map_matrix`, with one function per integer group value (for example per fold); groups may differ in width."""

    @F.arrow_udf("array<double>")
    def run(groups: pa.Array, values: pa.Array) -> pa.Array:
        g = groups.to_numpy(zero_copy_only=False)
        parts, places = [], []
        for key in np.unique(g):
            rows = np.flatnonzero(g == key)
            parts.append(to_lists(fns[int(key)](to_matrix(values.take(pa.array(rows))))))
            places.append(rows)
        if len(parts) < 2:
            return parts[0] if parts else values.cast(pa.list_(pa.float64()))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(places))))

    return run(group, features)


def partial_sums(
    df: DataFrame,
    keys: list[str],
    features: str,
    per_block: Callable[..., np.ndarray],
    with_key: bool = False,
) -> DataFrame:
    """Sum ``per_block(rows)`` -- an (r, c) matrix -- over all rows of every group.

    With ``with_key`` the function also receives the group's key tuple.

    Each task keeps one running matrix per group and emits it once, row by row; the emitted
    arrays are summed element-wise after a shuffle on (group, matrix row), so neither the rows
    nor a whole matrix per task ever meets in one place.  Returns (keys..., i, n, j, s).
    """
    key_fields = [df.schema[k] for k in keys]
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)
    schema = (key_types + ", " if keys else "") + "i int, n bigint, part array<double>"

    def run(batches):
        totals: dict[tuple, list] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = batch.column(batch.schema.get_field_index(features))
            if keys:
                table = batch.select(keys).to_pandas()
                groups = table.groupby(keys, dropna=False, sort=False).indices
            else:
                groups = {(): np.arange(batch.num_rows)}
            for key, rows in groups.items():
                key = key if isinstance(key, tuple) else (key,)
                x = to_matrix(values.take(pa.array(rows)) if keys else values)
                block = per_block(x, key) if with_key else per_block(x)
                if key in totals:
                    totals[key][0] += len(rows)
                    totals[key][1] += block
                else:
                    totals[key] = [len(rows), block]
        for key, (n, block) in totals.items():
            r = block.shape[0]
            columns = [pa.array([k] * r).cast(t) for k, t in zip(key, key_arrow)]
            columns += [
                pa.array(np.arange(r, dtype=np.int32)),
                pa.array(np.full(r, n, dtype=np.int64)),
                to_lists(block),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "i", "n", "part"])

    from pyspark.sql.pandas.types import to_arrow_type

    key_arrow = [to_arrow_type(f.dataType) for f in key_fields]
    partial = df.select(*keys, features).mapInArrow(run, schema)
    return (
        partial.select(*keys, "i", "n", F.posexplode("part").alias("j", "p"))
        .groupBy(*keys, "i", "j")
        .agg(F.sum("n").alias("n"), F.sum("p").alias("s"))
    )
