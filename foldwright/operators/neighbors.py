"""Exact k-nearest-neighbour join and classifier.

The training rows are split into cells around pivot rows, and large cells into even blocks.  A
query first visits the cell of its nearest pivot; the k-th distance found there bounds the search,
and only cells the triangle inequality cannot rule out are visited next.  A task compares one
block of training rows with one part of the queries and emits the k best per query, so no pairs
are emitted and no task grows with a hot cell.  Identical training vectors beyond the k with the
smallest ids can never be chosen and are dropped first, so copies do not form a hot block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.arrow import map_matrix, to_matrix
from foldwright.functions.exprs import doubles
from foldwright.operators.linear import Classifier, FittedClassifier, class_values
from foldwright.session import collect_bounded, materialize

MOST_ROWS = 32768  # a block of training rows; larger blocks are sent to fewer tasks
_SLACK = 1e-9  # relative room for rounding in the triangle inequality


def _distances(x: np.ndarray, y: np.ndarray, p: int) -> np.ndarray:
    out = np.empty((x.shape[0], y.shape[0]))
    for i in range(x.shape[0]):
        gap = y - x[i]
        out[i] = np.abs(gap).sum(1) if p == 1 else np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


class _Screen:
    """Lower precision distances from many rows, with which all rows but few are ruled out before :func:`_distances` decides.

    Blocks of columns of float32 stay in the processor's cache.  A rounded distance is off by at most (width + 4) half units of the
    sums of magnitudes, for p = 2 of their squares; rows beyond the k-th least by twice that can't be among the k best.
    """

    ROWS = 2048
    LARGEST = 1e15

    def __init__(self, x: np.ndarray, p: int):
        self.x, self.p = x, p
        self.magnitude = np.abs(x).sum(1).max(initial=0.0)
        self.usable = bool(self.magnitude < self.LARGEST)  # false for values that are no numbers
        self.blocks = [np.ascontiguousarray(x[a : a + self.ROWS].T, dtype=np.float32) for a in range(0, len(x), self.ROWS)] if self.usable else []
        self.gap = np.empty((x.shape[1], min(self.ROWS, len(x))), dtype=np.float32)

    def near(self, z: np.ndarray, k: int) -> np.ndarray:
        """Places of the rows that can be among the ``k`` nearest to ``z``, ascending."""
        reach = self.magnitude + np.abs(z).sum()
        if not (self.usable and reach < self.LARGEST) or len(self.x) <= k:
            return np.arange(len(self.x))
        column, out = z.astype(np.float32)[:, None], []
        for block in self.blocks:
            gap = np.subtract(block, column, out=self.gap[:, : block.shape[1]])
            out.append(np.abs(gap, out=gap).sum(0) if self.p == 1 else np.square(gap, out=gap).sum(0))
        d = np.concatenate(out)
        off = (len(z) + 8) * 2.0**-23 * (reach if self.p == 1 else reach * reach) + 1e-30
        return np.flatnonzero(d <= float(np.partition(d, k - 1)[k - 1]) + 2 * off)


def _block_best(k: int, p: int, label_type: pa.DataType):
    def run(train: pa.Table, query: pa.Table) -> pa.Table:
        schema = pa.schema([("qid", pa.int64()), ("tid", pa.int64()), ("tlabel", label_type), ("distance", pa.float64())])
        if train.num_rows == 0 or query.num_rows == 0:
            return schema.empty_table()
        x = to_matrix(train.column("x").combine_chunks())
        z = to_matrix(query.column("x").combine_chunks())
        tids = train.column("tid").to_numpy()
        qids = query.column("qid").to_numpy()
        take, owner, dist = [], [], []
        screen = _Screen(x, p)
        for q in range(len(qids)):
            some = screen.near(z[q], k)
            d = _distances(z[q : q + 1], x[some], p)[0]
            pool = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
            best = pool[np.lexsort((tids[some[pool]], d[pool]))][:k]
            take.append(some[best])
            owner.append(np.full(len(best), qids[q]))
            dist.append(d[best])
        rows = np.concatenate(take)
        return pa.Table.from_arrays(
            [pa.array(np.concatenate(owner)), pa.array(tids[rows]), train.column("tlabel").combine_chunks().take(pa.array(rows)), pa.array(np.concatenate(dist))],
            schema=schema,
        )

    return run


def _keep_best(candidates: DataFrame, k: int) -> DataFrame:
    """The k best per query; Spark applies the limit before the shuffle as well."""
    order = Window.partitionBy("qid").orderBy("distance", "tid")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    train: DataFrame,
    query: DataFrame,
    k: int,
    p: int = 2,
    features: str = "features",
    row_id: str = "row_id",
    label: str = "label",
    pivots: int = 32,
    block_rows: int = 4096,
) -> DataFrame:
    """(qid, tid, tlabel, distance, rank) with the k nearest training rows of every query.

    Ties go to the smaller training id.
    """
    label_field = train.schema[label]
    t = train.select(F.col(row_id).cast("bigint").alias("tid"), doubles(features).alias("x"), F.col(label).alias("tlabel"))
    q = query.select(F.col(row_id).cast("bigint").alias("qid"), doubles(features).alias("x"))

    copies = Window.partitionBy(F.xxhash64("x"), "x").orderBy("tid")
    t = t.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k).drop("_copy")

    heads = (
        t.select("tid", "x").orderBy(F.md5(F.col("tid").cast("string")), "tid").limit(pivots).collect()
    )
    if not heads:
        raise ValueError("no training rows")
    centres = np.array([r["x"] for r in heads])

    def to_cell(x: np.ndarray) -> np.ndarray:
        d = _distances(x, centres, p)
        cell = d.argmin(1)
        return np.stack([cell.astype(float), d[np.arange(len(x)), cell]], axis=1)

    t = materialize(t.withColumn("_c", map_matrix(to_cell, "x")).select("tid", "x", "tlabel", F.col("_c")[0].cast("int").alias("cell"), F.col("_c")[1].alias("_d")))
    stats = collect_bounded(t.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("_d").alias("r")), len(centres), "cells")
    size = {r["cell"]: r["n"] for r in stats}
    cells = np.array(sorted(size))
    radius = np.array([next(r["r"] for r in stats if r["cell"] == c) for c in cells])
    block_rows = max(block_rows, min(MOST_ROWS, sum(size.values()) // 64))
    live = centres[cells]
    blocks = {int(c): math.ceil(size[c] / block_rows) for c in cells}
    n_blocks = F.create_map(*[F.lit(v) for c, b in blocks.items() for v in (c, b)])

    left = t.withColumn("block", F.pmod(F.xxhash64("tid"), F.element_at(n_blocks, F.col("cell"))).cast("int")).select("tid", "x", "tlabel", "cell", "block")
    schema = f"qid bigint, tid bigint, tlabel {label_field.dataType.simpleString()}, distance double"
    from pyspark.sql.pandas.types import to_arrow_type

    best = _block_best(k, p, to_arrow_type(label_field.dataType))

    def visit(pairs: DataFrame) -> DataFrame:
        """Top k per (query, block) for (qid, x, cell) rows."""
        demand = {r["cell"]: r["n"] for r in collect_bounded(pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), len(centres), "cells")}
        if not demand:
            return pairs.sparkSession.createDataFrame([], schema)
        part_rows = max(4096, min(MOST_ROWS // 2, sum(demand.values()) // (8 * len(demand))))
        parts = {int(c): math.ceil(n / part_rows) for c, n in demand.items()}
        n_parts = F.create_map(*[F.lit(v) for c, n in parts.items() for v in (c, n)])
        right = (
            pairs.withColumn("part", F.pmod(F.xxhash64("qid"), F.element_at(n_parts, F.col("cell"))).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(n_blocks, F.col("cell")) - 1)))
        )
        wide = left.filter(F.col("cell").isin(list(parts))).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.element_at(n_parts, F.col("cell")) - 1))
        )
        keys = ["cell", "block", "part"]
        return wide.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, schema)

    def own_cell(x: np.ndarray) -> np.ndarray:
        return cells[_distances(x, live, p).argmin(1)][:, None].astype(float)

    home = q.withColumn("cell", map_matrix(own_cell, "x")[0].cast("int"))
    first = materialize(_keep_best(visit(home), k).drop("rank"))
    bound = first.groupBy("qid").agg(F.max("distance").alias("_far"), F.count(F.lit(1)).alias("_n"))

    counts = np.array([size[c] for c in cells])

    def reachable(x: np.ndarray) -> np.ndarray:
        """Flag per cell; the last input column is the distance bound (inf where unknown)."""
        far, x = x[:, -1], x[:, :-1]
        d = _distances(x, live, p)
        top = d + radius
        order = np.argsort(top, axis=1)
        enough = np.cumsum(counts[order], axis=1) >= min(k, counts.sum())
        general = np.take_along_axis(top, order, 1)[np.arange(len(x)), enough.argmax(1)]
        limit = np.minimum(far, general)
        flags = (d - radius <= (limit * (1 + _SLACK))[:, None] + _SLACK).astype(float)
        flags[np.arange(len(x)), d.argmin(1)] = 0.0
        return flags

    limit = F.when(F.col("_n") >= k, F.col("_far")).otherwise(F.lit(float("inf")))
    numbers = F.array(*[F.lit(int(c)) for c in cells])
    more = (
        q.join(bound, "qid", "left")
        .withColumn("_f", map_matrix(reachable, F.concat("x", F.array(F.coalesce(limit, F.lit(float("inf")))))))
        .select("qid", "x", F.explode_outer(F.array_compact(F.transform("_f", lambda v, i: F.when(v > 0, F.get(numbers, i))))).alias("cell"))
        .filter("cell IS NOT NULL")
    )
    return _keep_best(first.unionByName(visit(more)), k)


def vote(neighbors: DataFrame, weights: str = "uniform") -> DataFrame:
    """(qid, prediction): the class with most votes, the smaller class on a tie.

    With distance weights, exact matches outvote everything else.
    """
    tally = tallies(neighbors, weights)
    return tally.groupBy("qid").agg(F.min_by("tlabel", F.struct(-F.col("v"), F.col("tlabel"))).alias("prediction"))


def tallies(neighbors: DataFrame, weights: str = "uniform") -> DataFrame:
    """(qid, tlabel, v): votes of the classes among the neighbours."""
    n = neighbors
    if weights == "distance":
        n = n.withColumn("_exact", F.min("distance").over(Window.partitionBy("qid")) == 0)
        w = F.when(F.col("_exact"), (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.col("distance"))
    elif weights == "uniform":
        w = F.lit(1.0)
    else:
        raise ValueError(f"unknown weights: {weights}")
    return n.groupBy("qid", "tlabel").agg(F.sum(w).alias("v"))


@dataclass
class NeighborModel(FittedClassifier):
    train: DataFrame
    k: int
    p: int
    weights: str
    features: str
    row_id: str
    label: str
    classes: list

    def scores(self, df: DataFrame, name: str = "scores") -> DataFrame:
        """Shares of the votes, in the order of ``classes``."""
        found = tallies(nearest(self.train, df, self.k, self.p, self.features, self.row_id, self.label), self.weights)
        shares = found.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("tlabel", "v"))).alias("_v"), F.sum("v").alias("_n"))
        row = F.array(*[F.coalesce(F.try_element_at("_v", F.lit(c)), F.lit(0.0)) / F.col("_n") for c in self.classes])
        return df.join(shares.select(F.col("qid").alias(self.row_id), row.alias(name)), self.row_id, "left")

    def probabilities(self, df: DataFrame, name: str = "probability") -> DataFrame:
        return self.scores(df, name)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        found = nearest(self.train, df, self.k, self.p, self.features, self.row_id, self.label)
        votes = vote(found, self.weights).select(F.col("qid").alias(self.row_id), F.col("prediction").alias(name))
        return df.join(votes, self.row_id, "left")


class KNeighbors(Classifier):
    def __init__(self, n_neighbors=1, weights="uniform", p=2, **kw):
        super().__init__(**kw)
        self.n_neighbors, self.weights, self.p = int(n_neighbors), weights, int(p)

    def fit(self, df: DataFrame) -> NeighborModel:
        return NeighborModel(df, self.n_neighbors, self.p, self.weights, self.features, self.row_id, self.label, class_values(df, self.label))
