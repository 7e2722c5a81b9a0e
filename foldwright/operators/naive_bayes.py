"""Gaussian, Bernoulli and multinomial naive Bayes from one grouped aggregation.

``fit`` reads the data once and yields the models of all folds: the statistics are grouped by
fold, and the training statistics of a fold are the total minus its own part.  The parameters are
folds x classes x columns numbers; scoring is a map over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.arrow import map_matrix, map_matrix_by
from foldwright.functions.constants import GAUSSIAN_EPSILON
from foldwright.functions.exprs import argmax_index, clip_nonnegative, doubles, softmax
from foldwright.operators.moments import held_out_complement, held_out_moments, long_form, moments
from foldwright.session import collect_bounded

MAX_PARAMETERS = 20_000_000


# ---------------------------------------------------------------- statistics

def class_sizes(df: DataFrame, label: str, fold: str | None = None, k: int = 0) -> DataFrame:
    """(fold?, label, n_c): rows per class; with ``fold``, of the other folds."""
    keys = [fold] if fold else []
    sizes = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n_c"))
    return held_out_complement(sizes, k, [label], ["n_c"], fold) if fold else sizes


def gaussian_stats(
    df: DataFrame, label: str, features: str, fold: str | None = None, k: int = 0, standardize: bool = False
) -> DataFrame:
    """(fold?, label, pos, n, mean, var, mu, sd): population variance plus the smoothing constant.

    With ``standardize`` the class moments are those of (x - mu) / sd, where mu and sd come from
    the same training rows.  Scaling is affine, so it is applied to the moments and costs no
    second pass; otherwise mu is 0 and sd is 1.
    """
    keys = [fold] if fold else []
    stats = moments(df, [*keys, label], features)
    if fold:
        stats = held_out_moments(stats, k, [label, "pos"], fold)
    return gaussian_from_sums(stats, keys, label, standardize)


def gaussian_from_sums(stats: DataFrame, keys: list[str], label: str, standardize: bool = False) -> DataFrame:
    mean = F.col("s") / F.col("n")
    var = F.col("m2") / F.col("n")
    if not standardize:
        return stats.select(
            *keys, label, "pos", "n", mean.alias("mean"), (var + GAUSSIAN_EPSILON).alias("var"), F.lit(0.0).alias("mu"), F.lit(1.0).alias("sd")
        )
    centre = stats.groupBy(*keys, "pos").agg((F.sum("s") / F.sum("n")).alias("mu"))
    spread = F.sum(F.col("m2") + F.when(F.col("n") > 0, F.col("n") * (mean - F.col("mu")) * (mean - F.col("mu"))).otherwise(0.0))
    overall = stats.join(centre, [*keys, "pos"]).groupBy(*keys, "pos", "mu").agg(F.sqrt(spread / F.sum("n")).alias("sd"))
    scale = overall.select(*keys, "pos", "mu", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")).alias("sd"))
    return stats.join(scale, [*keys, "pos"]).select(
        *keys, label, "pos", "n",
        ((mean - F.col("mu")) / F.col("sd")).alias("mean"),
        (var / (F.col("sd") * F.col("sd")) + GAUSSIAN_EPSILON).alias("var"),
        "mu", "sd",
    )


def _count_stats(df: DataFrame, label: str, features: str, measure, fold: str | None, k: int) -> DataFrame:
    keys = [fold] if fold else []
    stats = long_form(df, [*keys, label], features).groupBy(*keys, label, "pos").agg(measure(F.col("x")).alias("n_cj"))
    return held_out_complement(stats, k, [label, "pos"], ["n_cj"], fold) if fold else stats


def multinomial_stats(
    df: DataFrame, label: str, features: str, alpha: float = 1.0, fold: str | None = None, k: int = 0
) -> DataFrame:
    """(fold?, label, pos, logp); negative inputs count as zero."""
    keys = [fold] if fold else []
    clipped = df.withColumn(features, clip_nonnegative(doubles(features)))
    return multinomial_from_counts(_count_stats(clipped, label, features, F.sum, fold, k), keys, label, alpha)


def multinomial_from_counts(stats: DataFrame, keys: list[str], label: str, alpha: float) -> DataFrame:
    """(keys..., label, pos, logp) from the sums n_cj of every class and column."""
    total = stats.groupBy(*keys, label).agg(F.sum("n_cj").alias("_n"), F.count(F.lit(1)).alias("_d"))
    logp = F.log((F.col("n_cj") + alpha) / (F.col("_n") + alpha * F.col("_d")))
    return stats.join(total, [*keys, label]).select(*keys, label, "pos", logp.alias("logp"))


def bernoulli_stats(
    df: DataFrame, label: str, features: str, alpha: float = 1.0, fold: str | None = None, k: int = 0
) -> DataFrame:
    """(fold?, label, pos, p) with p = (n_cj + alpha) / (n_c + 2 alpha), inputs cut at > 0."""
    keys = [fold] if fold else []
    stats = _count_stats(df, label, features, lambda x: F.sum((x > 0).cast("bigint")), fold, k)
    return bernoulli_from_counts(stats, class_sizes(df, label, fold, k), keys, label, alpha)


def bernoulli_from_counts(stats: DataFrame, sizes: DataFrame, keys: list[str], label: str, alpha: float) -> DataFrame:
    """(keys..., label, pos, p) from the positive counts n_cj and the class sizes n_c."""
    p = (F.col("n_cj") + alpha) / (F.col("n_c") + 2 * alpha)
    return stats.join(sizes, [*keys, label]).select(*keys, label, "pos", p.alias("p"))


def log_priors(sizes: DataFrame, keys: list[str], label: str, fit_prior: bool = True) -> DataFrame:
    """(keys..., label, n_c, log_prior) from class sizes (one row per class and key)."""
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    prior = F.log(F.col("n_c") / F.sum("n_c").over(every)) if fit_prior else -F.log(F.count(F.lit(1)).over(every))
    return sizes.filter("n_c > 0").select(*keys, label, "n_c", prior.alias("log_prior"))


# ---------------------------------------------------------------- scoring

@dataclass
class NaiveBayesModel:
    """Per fold (or under key -1 without folds): classes, log priors, weights.

    The joint log-likelihood of every kind here is linear in (x, x^2) or in x, so a batch is scored
    with one or two matrix products.
    """

    kind: str
    classes: list
    parts: dict[int, dict[str, np.ndarray]]
    features: str
    fold: str | None

    def _scorer(self, p: dict[str, np.ndarray]):
        kind = self.kind

        def score(x: np.ndarray) -> np.ndarray:
            if kind == "gaussian":
                centred = (x - p["mu"]) / p["sd"] - p["centre"]
                return p["bias"] + centred @ p["linear"].T + (centred * centred) @ p["square"].T
            if kind == "bernoulli":
                x = (x > 0).astype(np.float64)
            else:
                x = np.maximum(x, 0.0)
            return p["bias"] + x @ p["linear"].T

        return score

    def scores(self, df: DataFrame, name: str = "scores") -> DataFrame:
        if self.fold:
            fns = {f: self._scorer(p) for f, p in self.parts.items()}
            return df.withColumn(name, map_matrix_by(fns, self.fold, self.features))
        return df.withColumn(name, map_matrix(self._scorer(self.parts[-1]), self.features))

    def probabilities(self, df: DataFrame, name: str = "probability") -> DataFrame:
        """Class probabilities, in the order of ``classes``."""
        return self.scores(df, name).withColumn(name, softmax(name))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        lookup = F.array(*[F.lit(c) for c in self.classes])
        return self.scores(df, "_scores").withColumn(name, F.get(lookup, argmax_index("_scores"))).drop("_scores")


def _assemble(rows, fold, label, fields) -> tuple[list, dict[int, dict[str, np.ndarray]]]:
    """Parameter rows (one per column and class) to matrices per fold."""
    classes = sorted({r[label] for r in rows})
    index = {c: i for i, c in enumerate(classes)}
    widths: dict[int, int] = {}
    for r in rows:
        key = int(r[fold]) if fold else -1
        widths[key] = max(widths.get(key, 0), r["pos"] + 1)
    out = {key: {f: np.full((len(classes), width), np.nan) for f in fields} for key, width in widths.items()}
    for r in rows:
        part = out[int(r[fold]) if fold else -1]
        for f in fields:
            value = r[f]
            if value is not None:
                part[f][index[r[label]], r["pos"]] = value
    return classes, out


def _prior_vectors(sizes: DataFrame, fold, label, classes, fit_prior) -> dict[int, np.ndarray]:
    index = {c: i for i, c in enumerate(classes)}
    counts: dict[int, np.ndarray] = {}
    for r in collect_bounded(sizes, MAX_PARAMETERS, "class sizes"):
        counts.setdefault(int(r[fold]) if fold else -1, np.zeros(len(classes)))[index[r[label]]] = r["n_c"]
    out = {}
    for f, n in counts.items():
        with np.errstate(divide="ignore"):
            seen = n > 0
            out[f] = np.where(seen, np.log(n / n.sum()) if fit_prior else -np.log(seen.sum()), -np.inf)
    return out


def fit_naive_bayes(
    df: DataFrame,
    kind: str,
    label: str = "label",
    features: str = "features",
    alpha: float = 1.0,
    fit_prior: bool = True,
    fold: str | None = None,
    k: int = 0,
    standardize: bool = False,
) -> NaiveBayesModel:
    """One model per fold in one pass, or a single model when ``fold`` is None."""
    sizes = class_sizes(df, label, fold, k)
    if kind == "gaussian":
        stats = gaussian_stats(df, label, features, fold, k, standardize)
    elif kind == "multinomial":
        stats = multinomial_stats(df, label, features, alpha, fold, k)
    elif kind == "bernoulli":
        stats = bernoulli_stats(df, label, features, alpha, fold, k)
    else:
        raise ValueError(f"unknown kind: {kind}")
    return naive_bayes_model(kind, stats, sizes, label, features, fold, fit_prior)


FIELDS = {"gaussian": ["mean", "var", "mu", "sd"], "multinomial": ["logp"], "bernoulli": ["p"]}


def naive_bayes_model(
    kind: str, stats: DataFrame, sizes: DataFrame, label: str = "label", features: str = "features", fold: str | None = None, fit_prior: bool = True
) -> NaiveBayesModel:
    """The model of class statistics (fold?, label, pos, parameters) and class sizes (fold?, label, n_c)."""
    rows = collect_bounded(stats, MAX_PARAMETERS, "class statistics")
    classes, raw = _assemble(rows, fold, label, FIELDS[kind])
    priors = _prior_vectors(sizes, fold, label, classes, fit_prior)
    parts = {}
    for f, p in raw.items():
        prior = priors[f]
        if kind == "gaussian":
            centre = np.nanmean(p["mean"], axis=0)
            mean, var = p["mean"] - centre, p["var"]
            bias = prior - 0.5 * np.sum(np.log(2 * np.pi * var) + mean * mean / var, axis=1)
            part = {"centre": centre, "linear": mean / var, "square": -0.5 / var}
            part["mu"], part["sd"] = np.nanmax(p["mu"], axis=0), np.nanmax(p["sd"], axis=0)
        elif kind == "multinomial":
            bias, part = prior.copy(), {"linear": p["logp"]}
        else:
            q = p["p"]
            bias = prior + np.sum(np.log1p(-q), axis=1)
            part = {"linear": np.log(q) - np.log1p(-q)}
        unseen = ~np.isfinite(prior)  # a class without training rows can never win
        for name in ("linear", "square"):
            if name in part:
                part[name] = np.where(unseen[:, None], 0.0, part[name])
        part["bias"] = np.where(unseen, -np.inf, bias)
        parts[f] = part
    return NaiveBayesModel(kind, classes, parts, features, fold)


def multinomial_sparse_stats(cells: DataFrame, label: str, feature: str, value: str, alpha: float = 1.0) -> DataFrame:
    """(feature, label, logp) from sparse cells; a feature absent from a class keeps its smoothed value.

    Cells are pre-aggregated to (label, feature) counts before anything else moves.
    """
    counts = cells.groupBy(label, feature).agg(F.sum(value).alias("n_cj"))
    width = counts.select(feature).distinct().agg(F.count(F.lit(1))).scalar()
    totals = counts.groupBy(label).agg(F.sum("n_cj").alias("_n"))
    classes = totals.agg(F.collect_list(F.struct(label, "_n"))).scalar()  # one entry per class
    grid = counts.groupBy(feature).agg(F.map_from_entries(F.collect_list(F.struct(label, "n_cj"))).alias("_seen"))
    each = grid.withColumn("_classes", classes).withColumn("_d", width).select(feature, "_seen", "_d", F.explode("_classes").alias("_c"))
    n_cj = F.coalesce(F.element_at("_seen", F.col("_c")[label]), F.lit(0))
    return each.select(feature, F.col("_c")[label].alias(label), F.log((n_cj + alpha) / (F.col("_c._n") + alpha * F.col("_d"))).alias("logp"))


def multinomial_sparse_scores(cells: DataFrame, logp: DataFrame, priors: DataFrame, row_id: str, feature: str, value: str, label: str) -> DataFrame:
    """(row_id, label, score) for sparse cells joined to a (feature, label, logp) table.

    For vocabularies too wide for a parameter matrix: a shuffle join on the feature, then sums per
    row.  A frequent feature makes a skewed join key; its right side is one row per class, so the
    adaptive skew split divides the left side only.
    """
    joined = cells.join(logp, feature).groupBy(row_id, label).agg(F.sum(F.col(value) * F.col("logp")).alias("_s"))
    return joined.join(priors.select(label, "log_prior"), label).select(row_id, label, (F.col("_s") + F.col("log_prior")).alias("score"))
