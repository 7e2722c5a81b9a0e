"""Totally random trees: columns and thresholds are drawn by a hash of (seed, tree, node), one aggregation a level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.session import collect_bounded

MAX_NODES = 1 << 22  # nodes of all trees, which the driver holds


def drawn(*parts) -> float:
    """A number in [0, 1) from the first 32 bits of md5 over the joined parts."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2.0**32


@dataclass
class RandomTrees:
    """Nodes are numbered from 1, the children of n are 2n and 2n+1; ``column`` is -1 at leaves."""

    column: np.ndarray
    threshold: np.ndarray

    @property
    def per_tree(self) -> int:
        return self.column.shape[1]

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """Node that every row (rows, columns) reaches in every tree; missing numbers go right."""
        at = np.ones((len(x), len(self.column)), dtype=np.int64)
        tree = np.arange(len(self.column))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.per_tree.bit_length() - 2):
            column = self.column[tree, at]
            right = ~(x[rows, np.maximum(column, 0)] <= self.threshold[tree, at])
            at = np.where(column < 0, at, 2 * at + right)
        return at


def matrix(cells: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column without null rows; null cells become NaN."""
    values = cells.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(values) != len(cells) * width:
        raise ValueError(f"feature arrays must all have {width} numbers")
    return values.reshape(-1, width)


def _ranges(df: DataFrame, features: str, width: int, trees: RandomTrees, asked: np.ndarray) -> DataFrame:
    """(tree, node, n, lo, hi) of the open nodes: rows, and the range of the column ``asked`` there (-1: not open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = asked.size
        n, lo, hi = np.zeros(size, dtype=np.int64), np.full(size, np.inf), np.full(size, -np.inf)
        base = np.arange(len(asked)) * asked.shape[1]
        for batch in batches:
            x = matrix(batch.column(0), width)
            at = trees.nodes(x)
            column = asked[np.arange(len(asked)), at]
            rows, tree = np.nonzero(column >= 0)
            place, value = base[tree] + at[rows, tree], x[rows, column[rows, tree]]
            n += np.bincount(place, minlength=size)
            known = ~np.isnan(value)
            np.minimum.at(lo, place[known], value[known])
            np.maximum.at(hi, place[known], value[known])
        full = np.flatnonzero(n)
        tree, node = np.divmod(full, asked.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (tree, node, n[full], lo[full], hi[full])], ["tree", "node", "n", "lo", "hi"])

    parts = df.select(features).filter(F.col(features).isNotNull()).mapInArrow(run, "tree long, node long, n long, lo double, hi double")
    return parts.groupBy("tree", "node").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def grow(df: DataFrame, features: str, width: int, n_trees: int, max_depth: int, min_split: int = 2, min_leaf: int = 1, seed: int = 1) -> RandomTrees:
    """Split every node of at least ``min_split`` rows at a threshold drawn between the ends of a drawn column.

    A node whose drawn column is constant, or whose split leaves a child with fewer than ``min_leaf`` rows, tries the next column
    in the following pass, until all have been tried.  A pass reads the rows once for all open nodes of all trees; the splits do
    not depend on the partitioning.
    """
    per_tree = 2 ** (max_depth + 1)
    if n_trees * per_tree > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} tree nodes")
    trees = RandomTrees(np.full((n_trees, per_tree), -1, dtype=np.int64), np.zeros((n_trees, per_tree)))
    asked = np.full((n_trees, per_tree), -1, dtype=np.int64)
    tries: dict[tuple[int, int], int] = {}

    def ask(tree: int, node: int) -> None:
        k = tries.setdefault((tree, node), 0)
        if k < width:
            asked[tree, node] = (int(drawn(seed, "column", tree, node) * width) + k) % width

    for tree in range(n_trees):
        ask(tree, 1)
    while (asked >= 0).any():
        found = {(r["tree"], r["node"]): r for r in collect_bounded(_ranges(df, features, width, trees, asked), MAX_NODES, "tree nodes")}
        now = list(zip(*np.nonzero(asked >= 0), strict=True))
        columns = {key: int(asked[key]) for key in now}
        asked[:] = -1
        thin = {(t, v // 2) for t, v in columns if v > 1 and tries[t, v] == 0 and ((t, v) not in found or found[t, v]["n"] < min_leaf)}
        for t, v in thin:  # the split of the parent does not hold
            trees.column[t, v] = -1
            tries.pop((t, 2 * v), None), tries.pop((t, 2 * v + 1), None)
            tries[t, v] += 1
            ask(t, v)
        for t, v in now:
            row = found.get((t, v))
            if (t, v // 2) in thin or row is None or v >= per_tree // 2 or row["n"] < max(min_split, 2 * min_leaf):
                continue
            if not row["lo"] < row["hi"]:
                tries[t, v] += 1
                ask(t, v)
                continue
            cut = row["lo"] + drawn(seed, "threshold", t, v, tries[t, v]) * (row["hi"] - row["lo"])
            trees.column[t, v], trees.threshold[t, v] = columns[t, v], cut if cut < row["hi"] else row["lo"]
            if v < per_tree // 4 or min_leaf > 1:
                ask(t, 2 * v)
                ask(t, 2 * v + 1)
    return trees
