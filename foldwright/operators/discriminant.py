"""Linear and quadratic discriminant analysis from class moments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.functions.arrow import map_matrix, partial_sums
from foldwright.functions.exprs import doubles
from foldwright.operators.linear import Classifier, FittedClassifier, LinearModel, class_values
from foldwright.operators.moments import moments
from foldwright.operators.project import column_means, gram_sums
from foldwright.session import collect_bounded

MAX_ENTRIES = 30_000_000


@dataclass
class ClassMoments:
    classes: list
    n: np.ndarray  # (k,)
    mean: np.ndarray  # (k, d)
    scatter: np.ndarray  # (k, d, d): centred sums of products


def class_moments(df: DataFrame, label: str, features: str) -> ClassMoments:
    """Counts, means and centred product sums per class; two passes, no row leaves its task."""
    arr = df.select(label, doubles(features).alias(features))
    centre = column_means(arr, features)
    d = len(centre)
    classes = class_values(arr, label)
    k = len(classes)
    if k * d * d > MAX_ENTRIES:
        raise ValueError("class covariances are too large for the driver")
    index = {c: i for i, c in enumerate(classes)}
    n, mean, scatter = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
    for r in collect_bounded(moments(arr, [label], features), k * d, "class means"):
        c = index[r[label]]
        n[c] = r["n"]
        mean[c, r["pos"]] = r["s"] / r["n"]
    for r in collect_bounded(gram_sums(arr, features, centre, [label]), k * d * d, "class covariances"):
        scatter[index[r[label]], r["i"], r["j"]] = r["s"]
    shift = mean - centre
    scatter -= n[:, None, None] * shift[:, :, None] * shift[:, None, :]
    return ClassMoments(classes, n, mean, scatter)


def within_covariance(df: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """(i, j, cov): pooled within-class covariance with n - k degrees of freedom, as a table."""
    arr = df.select(label, doubles(features).alias(features))
    centre = column_means(arr, features)
    grams = gram_sums(arr, features, centre, [label])
    shift = F.create_map(*[v for i, c in enumerate(centre) for v in (F.lit(i), F.lit(float(c)))])
    means = moments(arr, [label], features).select(
        label, "pos", F.col("n").alias("_n"), (F.col("s") / F.col("n") - F.element_at(shift, F.col("pos"))).alias("m")
    )
    a = means.select(label, F.col("pos").alias("i"), F.col("m").alias("mi"))
    b = means.select(label, F.col("pos").alias("j"), F.col("m").alias("mj"))
    joined = grams.join(a, [label, "i"]).join(b, [label, "j"])
    pooled = joined.groupBy("i", "j").agg(
        F.sum(F.col("s") - F.col("n") * F.col("mi") * F.col("mj")).alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")
    )
    return pooled.select("i", "j", (F.col("w") / (F.col("n") - F.col("k"))).alias("cov"))


class LDA(Classifier):
    """Linear discriminant; ``shrinkage`` is None, ``auto`` (Ledoit-Wolf) or ``manual``."""

    def __init__(self, shrinkage=None, shrinkage_factor=0.5, n_components=10, tol=1e-4, **kw):
        super().__init__(**kw)
        self.shrinkage = None if shrinkage in (None, "None") else shrinkage
        if self.shrinkage not in (None, "auto", "manual"):
            raise ValueError(f"unknown shrinkage: {shrinkage}")
        self.shrinkage_factor, self.tol = float(shrinkage_factor or 0.5), float(tol)

    def _auto(self, df: DataFrame, m: ClassMoments) -> np.ndarray:
        """Shrunk covariance per class on standardised columns; one more pass for the fourth powers."""
        index = {c: i for i, c in enumerate(m.classes)}
        d = m.mean.shape[1]
        sd = np.sqrt(np.einsum("kii->ki", m.scatter) / m.n[:, None])
        sd[sd == 0] = 1.0

        def block(x: np.ndarray, key: tuple) -> np.ndarray:
            c = index[key[0]]
            z = (x - m.mean[c]) / sd[c]
            return np.array([[((z * z).sum(1) ** 2).sum()]])

        arr = df.select(self.label, doubles(self.features).alias(self.features))
        fourth = {r[self.label]: r["s"] for r in collect_bounded(partial_sums(arr, [self.label], self.features, block, with_key=True), len(index), "fourth powers")}
        out = np.empty_like(m.scatter)
        for c, i in index.items():
            n = m.n[i]
            cov = m.scatter[i] / n / np.outer(sd[i], sd[i])
            mu = np.trace(cov) / d
            spread = (cov * cov).sum()
            beta = (fourth[c] / n - spread) / (d * n)
            delta = (spread - 2 * mu * np.trace(cov) + d * mu * mu) / d
            share = 0.0 if delta <= 0 else min(beta, delta) / delta
            out[i] = ((1 - share) * cov + share * mu * np.eye(d)) * np.outer(sd[i], sd[i])
        return out

    def fit(self, df: DataFrame) -> LinearModel:
        m = class_moments(df, self.label, self.features)
        k, d = m.mean.shape
        prior = m.n / m.n.sum()
        if self.shrinkage is None:
            pooled = m.scatter.sum(0) / max(m.n.sum() - k, 1)
            values, vectors = np.linalg.eigh(pooled)
            keep = values > self.tol**2 * max(values.max(), 1e-300)
            inverse = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
        else:
            each = m.scatter / m.n[:, None, None]
            if self.shrinkage == "auto":
                each = self._auto(df, m)
            else:
                trace = np.einsum("kii->k", each) / d
                f = self.shrinkage_factor
                each = (1 - f) * each + f * trace[:, None, None] * np.eye(d)
            inverse = np.linalg.pinv(np.einsum("k,kij->ij", prior, each))
        coef = m.mean @ inverse
        bias = -0.5 * (m.mean * coef).sum(1) + np.log(prior)
        return LinearModel(np.hstack([coef, bias[:, None]]), m.classes, self.features)


@dataclass
class QuadraticModel(FittedClassifier):
    classes: list
    mean: np.ndarray
    root: np.ndarray  # (k, d, d): columns scaled by 1/sqrt(variance)
    bias: np.ndarray
    features: str

    def scores(self, df: DataFrame, name: str = "scores") -> DataFrame:
        def run(x: np.ndarray) -> np.ndarray:
            out = np.empty((x.shape[0], len(self.bias)))
            for c in range(len(self.bias)):
                z = (x - self.mean[c]) @ self.root[c]
                out[:, c] = -0.5 * (z * z).sum(1) + self.bias[c]
            return out

        return df.withColumn(name, map_matrix(run, doubles(self.features)))


class QDA(Classifier):
    """Quadratic discriminant; variances are blended as (1 - reg) v + reg and must stay positive."""

    def __init__(self, reg_param=0.5, **kw):
        super().__init__(**kw)
        self.reg_param = float(reg_param)

    def fit(self, df: DataFrame) -> QuadraticModel:
        m = class_moments(df, self.label, self.features)
        if (m.n < 2).any():
            raise ValueError("every class needs at least two rows")
        prior = m.n / m.n.sum()
        roots, bias = [], []
        for c in range(len(m.classes)):
            values, vectors = np.linalg.eigh(m.scatter[c] / (m.n[c] - 1))
            values = (1 - self.reg_param) * np.maximum(values, 0.0) + self.reg_param
            if (values <= 0).any():
                raise ValueError("a class has variances that are not positive")
            roots.append(vectors / np.sqrt(values))
            bias.append(np.log(prior[c]) - 0.5 * np.log(values).sum())
        return QuadraticModel(m.classes, m.mean, np.array(roots), np.array(bias), self.features)
