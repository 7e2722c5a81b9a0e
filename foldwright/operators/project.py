"""Projections: PCA, ICA, polynomial features, random Fourier features, Nystroem kernel maps.

Every fit reduces the rows to a matrix whose size depends on the number of columns or components
only; that matrix is solved on the driver and sent to the tasks, and the transform is a map.
"""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.functions.arrow import map_matrix, partial_sums
from foldwright.functions.exprs import doubles
from foldwright.operators.moments import long_form
from foldwright.operators.select import width_of
from foldwright.operators.steps import FeatureStep, RowMap
from foldwright.session import collect_bounded

MAX_GRAM_COLUMNS = 4096
MAX_OUTPUT_COLUMNS = 200_000


def column_means(df: DataFrame, features: str) -> np.ndarray:
    rows = collect_bounded(
        long_form(df, [], features).groupBy("pos").agg(F.avg("x").alias("m"), F.count("x").alias("n")), MAX_OUTPUT_COLUMNS, "column means"
    )
    if not rows:
        raise ValueError("no rows to fit on")
    out = np.zeros(len(rows))
    for r in rows:
        out[r["pos"]] = r["m"]
    if not np.all(np.isfinite(out)):
        raise ValueError("features must be finite")
    return out


def collect_matrix(sums: DataFrame, rows: int, cols: int, what: str) -> tuple[int, np.ndarray]:
    """(n, matrix) from the (i, n, j, s) rows of :func:`partial_sums`."""
    out, n = np.zeros((rows, cols)), 0
    for r in collect_bounded(sums, rows * cols, what):
        out[r["i"], r["j"]] = r["s"]
        n = r["n"]
    return n, out


def gram_sums(df: DataFrame, features: str, centre: np.ndarray, keys: list[str] | None = None) -> DataFrame:
    """(keys..., i, n, j, s): sums of (x_i - c_i)(x_j - c_j)."""
    if len(centre) > MAX_GRAM_COLUMNS:
        raise ValueError(f"{len(centre)} columns are too many for a covariance matrix")

    def block(x: np.ndarray) -> np.ndarray:
        z = x - centre
        return z.T @ z

    return partial_sums(df, keys or [], features, block)


def covariance(df: DataFrame, features: str = "features") -> DataFrame:
    """(i, j, cov): sample covariance of every pair of columns."""
    arr = df.select(doubles(features).alias(features))
    centre = column_means(arr, features)
    return gram_sums(arr, features, centre).select("i", "j", (F.col("s") / (F.col("n") - 1)).alias("cov"))


class PCA(FeatureStep):
    """Fewest leading components whose variance share reaches ``keep_variance``."""

    def __init__(self, keep_variance: float = 0.9999, whiten: bool = False, n_components: int | None = None, **kw):
        super().__init__(**kw)
        self.keep_variance, self.whiten, self.n_components = float(keep_variance), whiten, n_components

    def spectrum(self, dataset: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean, eigenvalues descending, components as rows)."""
        arr = dataset.select(doubles(self.features).alias(self.features))
        mean = column_means(arr, self.features)
        d = len(mean)
        n, gram = collect_matrix(gram_sums(arr, self.features, mean), d, d, "covariance")
        return mean, *principal_axes(gram / max(n - 1, 1))

    def _fit(self, dataset: DataFrame) -> RowMap:
        mean, values, vectors = self.spectrum(dataset)
        basis, m = self.basis(values, vectors)
        return self._map(lambda a: map_matrix(lambda x: (x - mean) @ basis, a), components=m, eigenvalues=values)

    def basis(self, values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, int]:
        """The kept axes as columns, scaled to unit variance when whitening, and their number."""
        if self.n_components is not None:
            m = min(int(self.n_components), len(values))
        else:
            share = np.cumsum(values) / max(values.sum(), 1e-300)
            m = min(int(np.searchsorted(share, self.keep_variance)) + 1, len(values))
        basis = vectors[:m].T
        if self.whiten:
            basis = basis / np.sqrt(np.maximum(values[:m], 1e-300))
        return basis, m


def principal_axes(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues descending, axes as rows), the largest entry of every axis being positive."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order].T
    signs = np.sign(vectors[np.arange(len(values)), np.argmax(np.abs(vectors), axis=1)])
    return values, vectors * np.where(signs == 0, 1.0, signs)[:, None]


class PolynomialFeatures(FeatureStep):
    """All monomials up to ``degree``, ordered by degree and then by column index."""

    def __init__(self, degree: int = 2, interaction_only: bool = False, include_bias: bool = True, **kw):
        super().__init__(**kw)
        self.degree, self.interaction_only, self.include_bias = int(degree), interaction_only, include_bias

    def index_sets(self, width: int) -> list[tuple[int, ...]]:
        choose = combinations if self.interaction_only else combinations_with_replacement
        sets: list[tuple[int, ...]] = []
        for size in range(0 if self.include_bias else 1, self.degree + 1):
            for s in choose(range(width), size):
                sets.append(s)
                if len(sets) > MAX_OUTPUT_COLUMNS:
                    raise ValueError("polynomial expansion would have too many columns")
        return sets

    def _fit(self, dataset: DataFrame) -> RowMap:
        sets = self.index_sets(width_of(dataset, self.features))

        def expand(x: np.ndarray) -> np.ndarray:
            out = np.empty((x.shape[0], len(sets)))
            for j, s in enumerate(sets):
                out[:, j] = 1.0 if not s else x[:, s[0]]
                for c in s[1:]:
                    out[:, j] *= x[:, c]
            return out

        return self._map(lambda a: map_matrix(expand, doubles(a)), columns=len(sets))


class KitchenSinks(FeatureStep):
    """Random Fourier features of the RBF kernel: sqrt(2/D) cos(xW + b)."""

    def __init__(self, gamma: float = 1.0, n_components: int = 100, seed: int = 1,
                 weights: np.ndarray | None = None, offset: np.ndarray | None = None, **kw):
        super().__init__(**kw)
        self.gamma, self.n_components, self.seed = float(gamma), int(n_components), seed
        self.weights, self.offset = weights, offset

    def _fit(self, dataset: DataFrame) -> RowMap:
        rng = np.random.default_rng(self.seed)
        d = width_of(dataset, self.features)
        w = self.weights if self.weights is not None else np.sqrt(2 * self.gamma) * rng.standard_normal((d, self.n_components))
        b = self.offset if self.offset is not None else rng.uniform(0, 2 * np.pi, w.shape[1])
        factor = np.sqrt(2.0 / w.shape[1])
        return self._map(lambda a: map_matrix(lambda x: factor * np.cos(x @ w + b), doubles(a)))


def kernel_matrix(x: np.ndarray, y: np.ndarray, kernel: str, gamma: float, degree: int, coef0: float) -> np.ndarray:
    if kernel == "poly":
        return (gamma * (x @ y.T) + coef0) ** degree
    if kernel == "sigmoid":
        return np.tanh(gamma * (x @ y.T) + coef0)
    if kernel == "rbf":
        sq = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
        return np.exp(-gamma * np.maximum(sq, 0.0))
    if kernel == "cosine":
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        return (x / np.where(nx == 0, 1, nx)[:, None]) @ (y / np.where(ny == 0, 1, ny)[:, None]).T
    if kernel == "chi2":
        if (x < 0).any() or (y < 0).any():
            raise ValueError("the chi2 kernel needs non-negative input")
        out = np.zeros((x.shape[0], y.shape[0]))
        for j in range(y.shape[0]):
            total = x + y[j]
            gap = (x - y[j]) ** 2
            out[:, j] = -np.divide(gap, total, out=np.zeros_like(gap), where=total != 0).sum(1)
        return np.exp(gamma * out)
    raise ValueError(f"unknown kernel: {kernel}")


class Nystroem(FeatureStep):
    """Kernel map through landmark rows: K(x, landmarks) K_mm^(-1/2).

    The landmarks are the rows with the smallest md5(row_id): the same rows on every run.
    """

    def __init__(self, kernel: str = "rbf", n_components: int = 100, gamma: float | None = None,
                 degree: int = 3, coef0: float = 0.0, **kw):
        super().__init__(**kw)
        self.kernel, self.n_components = kernel, int(n_components)
        self.gamma, self.degree, self.coef0 = gamma, int(degree or 3), float(coef0 or 0.0)

    def landmarks(self, dataset: DataFrame) -> np.ndarray:
        rows = (
            dataset.select(self.row_id, doubles(self.features).alias("_x"))
            .orderBy(F.md5(F.col(self.row_id).cast("string")), self.row_id)
            .limit(self.n_components)
            .collect()
        )
        if not rows:
            raise ValueError("no rows to fit on")
        return np.array([r["_x"] for r in rows])

    def kernel_map(self, dataset: DataFrame):
        basis = self.landmarks(dataset)
        gamma = float(self.gamma) if self.gamma is not None else 1.0 / basis.shape[1]
        prepare = (lambda x: np.maximum(x, 0.0)) if self.kernel == "chi2" else (lambda x: x)
        basis = prepare(basis)
        args = (self.kernel, gamma, self.degree, self.coef0)
        u, s, vt = np.linalg.svd(kernel_matrix(basis, basis, *args))
        root = (u / np.sqrt(np.maximum(s, 1e-12))) @ vt
        return lambda x: kernel_matrix(prepare(x), basis, *args) @ root.T

    def _fit(self, dataset: DataFrame) -> RowMap:
        fn = self.kernel_map(dataset)
        return self._map(lambda a: map_matrix(fn, doubles(a)))


class KernelPCA(FeatureStep):
    """Kernel principal components by PCA over the landmark map (no n x n matrix)."""

    def __init__(self, n_components: int = 100, kernel: str = "rbf", gamma: float | None = None,
                 degree: int = 3, coef0: float = 0.0, landmarks: int = 500, **kw):
        super().__init__(**kw)
        self.n_components = int(n_components)
        self.map = Nystroem(kernel, max(landmarks, self.n_components), gamma, degree, coef0, **kw)

    def _fit(self, dataset: DataFrame) -> RowMap:
        first = self.map.fit(dataset)
        pca = PCA(n_components=self.n_components, features=self.features)
        mean, values, vectors = pca.spectrum(first.transform(dataset))
        keep = values > 1e-12 * max(values.max(), 1e-300)
        m = min(self.n_components, int(keep.sum()))
        if m == 0:
            raise ValueError("every component was removed")
        basis = vectors[:m].T
        return self._map(
            lambda a: map_matrix(lambda x: (x - mean) @ basis, first.expression(a)), components=m, eigenvalues=values[:m]
        )


_CONTRASTS = {
    "logcosh": (np.tanh, lambda u: 1.0 - np.tanh(u) ** 2),
    "exp": (lambda u: u * np.exp(-(u**2) / 2), lambda u: (1 - u**2) * np.exp(-(u**2) / 2)),
    "cube": (lambda u: u**3, lambda u: 3 * u**2),
}


class FastICA(FeatureStep):
    """Fixed-point independent components; each iteration is one aggregate over the rows.

    ``parallel`` rotates all components together, ``deflation`` finds them one after another.  The
    fitted data should be persisted by the caller, as it is read once per iteration.
    """

    def __init__(self, n_components: int | None = None, algorithm: str = "parallel", whiten: bool = True,
                 fun: str = "logcosh", max_iter: int = 200, tol: float = 1e-4, seed: int = 1, **kw):
        super().__init__(**kw)
        self.n_components, self.algorithm, self.whiten, self.fun = n_components, algorithm, whiten, fun
        self.max_iter, self.tol, self.seed = max_iter, tol, seed

    def _fit(self, dataset: DataFrame) -> RowMap:
        arr = dataset.select(doubles(self.features).alias(self.features))
        if self.whiten:
            mean, values, vectors = PCA(features=self.features).spectrum(arr)
            rank = int((values > 1e-12 * max(values.max(), 1e-300)).sum())
            m = min(int(self.n_components or rank), rank)
            basis = vectors[:m].T / np.sqrt(values[:m])
        else:
            mean = np.zeros(width_of(arr, self.features))
            basis = np.eye(len(mean))
        m = basis.shape[1]
        w = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((m, m)))[0]
        if self.algorithm == "parallel":
            w = _decorrelate(w)
            for _ in range(self.max_iter):
                new = _decorrelate(self._step(arr, mean, basis, w))
                change = np.max(np.abs(np.abs((new * w).sum(1)) - 1))
                w = new
                if change < self.tol:
                    break
        elif self.algorithm == "deflation":
            for p in range(m):
                v = w[p] - w[:p].T @ (w[:p] @ w[p])
                v /= np.linalg.norm(v)
                for _ in range(self.max_iter):
                    new = self._step(arr, mean, basis, v[None, :])[0]
                    new -= w[:p].T @ (w[:p] @ new)
                    new /= np.linalg.norm(new)
                    change = abs(abs(new @ v) - 1)
                    v = new
                    if change < self.tol:
                        break
                w[p] = v
        else:
            raise ValueError(f"unknown algorithm: {self.algorithm}")
        unmix = basis @ w.T
        return self._map(lambda a: map_matrix(lambda x: (x - mean) @ unmix, doubles(a)), components=m)

    def _step(self, arr: DataFrame, mean: np.ndarray, basis: np.ndarray, w: np.ndarray) -> np.ndarray:
        """E[g(w z) z] - E[g'(w z)] w for every row of w."""
        g, dg = _CONTRASTS[self.fun]

        def block(x: np.ndarray) -> np.ndarray:
            z = (x - mean) @ basis
            u = z @ w.T
            return np.hstack([g(u).T @ z, dg(u).sum(0)[:, None]])

        r, c = w.shape
        n, total = collect_matrix(partial_sums(arr, [], self.features, block), r, c + 1, "fixed-point sums")
        return total[:, :c] / n - (total[:, c] / n)[:, None] * w


def _decorrelate(w: np.ndarray) -> np.ndarray:
    s, u = np.linalg.eigh(w @ w.T)
    return (u / np.sqrt(np.maximum(s, 1e-300))) @ u.T @ w
