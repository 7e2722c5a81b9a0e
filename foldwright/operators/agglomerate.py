"""Feature agglomeration: merge similar columns and pool each cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.functions.arrow import map_matrix, partial_sums
from foldwright.functions.exprs import doubles
from foldwright.operators.project import MAX_GRAM_COLUMNS, collect_matrix
from foldwright.operators.select import width_of
from foldwright.operators.steps import FeatureStep, RowMap


def pair_sums(df: DataFrame, affinity: str, features: str = "features") -> DataFrame:
    """(i, j, s): sum over rows of |x_i - x_j| (manhattan) or of x_i x_j (euclidean, cosine)."""
    arr = df.select(doubles(features).alias(features))

    def absolute(x: np.ndarray) -> np.ndarray:
        return np.stack([np.abs(x - x[:, i : i + 1]).sum(0) for i in range(x.shape[1])])

    block = absolute if affinity == "manhattan" else (lambda x: x.T @ x)
    return partial_sums(arr, [], features, block)


def column_distances(df: DataFrame, affinity: str, features: str = "features") -> DataFrame:
    """(i, j, distance) between every two columns, from one aggregate over the rows."""
    sums = pair_sums(df, affinity, features)
    if affinity == "manhattan":
        return sums.select("i", "j", F.col("s").alias("distance"))
    diagonal = sums.filter("i = j")
    a = diagonal.select(F.col("i"), F.col("s").alias("si"))
    b = diagonal.select(F.col("j"), F.col("s").alias("sj"))
    both = sums.join(a, "i").join(b, "j")
    if affinity == "euclidean":
        squared = F.greatest(F.col("si") + F.col("sj") - 2 * F.col("s"), F.lit(0.0))
        return both.select("i", "j", F.sqrt(F.when(F.col("i") == F.col("j"), 0.0).otherwise(squared)).alias("distance"))
    if affinity == "cosine":
        product = F.sqrt(F.col("si") * F.col("sj"))
        return both.select("i", "j", (1.0 - F.when(product == 0, 0.0).otherwise(F.col("s") / product)).alias("distance"))
    raise ValueError(f"unknown affinity: {affinity}")


def merge_columns(distance: np.ndarray, n_clusters: int, linkage: str) -> np.ndarray:
    """Cluster number per column; repeated merging of the closest pair (d x d, columns only)."""
    d = distance.shape[0]
    gap = distance.astype(float) ** 2 if linkage == "ward" else distance.astype(float)
    np.fill_diagonal(gap, np.inf)
    size = np.ones(d)
    member = np.arange(d)
    for _ in range(d - n_clusters):
        a, b = sorted(np.unravel_index(np.argmin(gap), gap.shape))
        if linkage == "complete":
            merged = np.maximum(gap[a], gap[b])
        elif linkage == "average":
            merged = (size[a] * gap[a] + size[b] * gap[b]) / (size[a] + size[b])
        elif linkage == "ward":
            with np.errstate(invalid="ignore"):
                merged = ((size[a] + size) * gap[a] + (size[b] + size) * gap[b] - size * gap[a, b]) / (size[a] + size[b] + size)
        else:
            raise ValueError(f"unknown linkage: {linkage}")
        dead = np.isinf(gap[a]) & np.isinf(gap[b])
        merged[dead] = np.inf
        gap[a, :] = gap[:, a] = merged
        gap[a, a] = np.inf
        gap[b, :] = gap[:, b] = np.inf
        size[a] += size[b]
        member[member == b] = a
    return np.unique(member, return_inverse=True)[1]


_POOL = {"mean": np.mean, "median": np.median, "max": np.max}


class FeatureAgglomeration(FeatureStep):
    def __init__(self, n_clusters: int = 25, affinity: str = "euclidean", linkage: str = "ward", pooling_func: str = "mean", **kw):
        super().__init__(**kw)
        if linkage == "ward" and affinity != "euclidean":
            raise ValueError("ward linkage needs euclidean distances")
        self.n_clusters, self.affinity, self.linkage, self.pooling_func = int(n_clusters), affinity, linkage, pooling_func

    def _fit(self, dataset: DataFrame) -> RowMap:
        d = width_of(dataset, self.features)
        if d > MAX_GRAM_COLUMNS:
            raise ValueError(f"{d} columns are too many to agglomerate")
        pairs = column_distances(dataset, self.affinity, self.features).select("i", "j", F.col("distance").alias("s"), F.lit(0).alias("n"))
        _, distance = collect_matrix(pairs, d, d, "column distances")
        cluster = merge_columns(distance, min(self.n_clusters, d), self.linkage)
        groups = [np.flatnonzero(cluster == c) for c in range(cluster.max() + 1)]
        pool = _POOL[self.pooling_func]
        return self._map(
            lambda a: map_matrix(lambda x: np.stack([pool(x[:, g], axis=1) for g in groups], axis=1), doubles(a)), clusters=cluster
        )
