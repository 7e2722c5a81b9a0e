"""Evaluate configurations over a trie of shared preprocessing prefixes, all folds at once.

Configurations that agree on their first steps share a path.  Every node of the trie fits its step once, for all held-out folds in one
pass: as long as the features do not depend on the fold, statistics are grouped by fold and each held-out fold gets the merged statistics
of the others; below, one row per held-out fold is grouped by it.  A fitted step is a matrix function per held-out fold.  Functions of a
path are composed and applied in one pass, so no node needs a table; a table of all folds is stored where a cached step took longer than
the least stage time and several nodes or configurations read it, and below steps that are fitted fold by fold.

The driver holds the trie, the functions (columns x folds numbers) and one record per run; rows stay in the tasks.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.functions.arrow import map_matrix, map_matrix_by, partial_sums
from foldwright.functions.constants import CODE_MISSING, CODE_OTHER, CODE_SHIFT, FAILED_COST, MIN_STAGE_SECONDS
from foldwright.functions.exprs import doubles
from foldwright.operators.metrics import bac_multiclass
from foldwright.operators.moments import counts_mode, exact_median, held_out_complement, held_out_moments, long_form, missing, squared_deviations
from foldwright.operators.naive_bayes import bernoulli_from_counts, gaussian_from_sums, multinomial_from_counts, naive_bayes_model
from foldwright.operators.project import MAX_GRAM_COLUMNS, PCA, principal_axes
from foldwright.operators.select import MAX_COLUMNS, chi2_from_moments, f_from_moments
from foldwright.plans.evaluate import _PREPROCESSORS, _yes, classifier_of, parameters
from foldwright.plans.space import CONSTANT_STEPS, STEPS
from foldwright.session import checkpoint_root, collect_bounded, scratch_path
from foldwright.sources.runlog_files import RUN_SCHEMA

Matrix = Callable[[np.ndarray], np.ndarray]
CACHED_STEPS = [s for s, cached in STEPS if cached]
MAX_CATEGORIES = 1_000_000
UNION_TABLES = 200  # prediction tables scored by one plan


# ---------------------------------------------------------------- views of the rows at a node

@dataclass
class View:
    """Rows (row_id, label, fold, features; ``held`` where ``wide``) and the functions that turn them into a node's features.

    A chain entry is one function, or one per held-out fold.  ``weights`` are class weights per held-out fold.
    """

    df: DataFrame
    folds: int
    instances: list[int]
    wide: bool = False
    chain: tuple = ()
    weights: dict[int, dict] | None = None

    @property
    def plain(self) -> bool:
        """The features are the same for every held-out fold."""
        return not self.wide and not any(isinstance(f, dict) for f in self.chain)

    def then(self, step: Matrix | dict[int, Matrix]) -> View:
        return replace(self, chain=(*self.chain, step))

    def _composed(self, held: int) -> Matrix:
        fns = [f[held] if isinstance(f, dict) else f for f in self.chain]
        return partial(reduce, lambda x, f: f(x), fns)

    def mapped(self, df: DataFrame) -> DataFrame:
        if not self.chain:
            return df
        if not self.plain:  # widths differ between held-out folds
            return df.withColumn("features", map_matrix_by({h: self._composed(h) for h in self.instances}, "held", "features"))
        return df.withColumn("features", map_matrix(self._composed(-1), "features"))

    def _spread(self, held: Column) -> DataFrame:
        return self.df.withColumn("held", F.explode(held))

    def _all_held(self) -> Column:
        return F.array(*[F.lit(int(h)) for h in self.instances])

    def training(self) -> DataFrame:
        """One row per held-out fold that the row trains for."""
        rows = self.df.filter("fold <> held") if self.wide else self._spread(F.filter(self._all_held(), lambda h: h != F.col("fold")))
        return self.mapped(rows)

    def held_out(self) -> DataFrame:
        rows = self.df.filter("fold = held") if self.wide else self.df.filter(F.col("fold").isin(self.instances)).withColumn("held", F.col("fold"))
        return self.mapped(rows)

    def whole(self) -> DataFrame:
        """Every row for every held-out fold."""
        return self.mapped(self.df if self.wide else self._spread(self._all_held()))

    def cells(self, keys: list[str]) -> tuple[DataFrame, str]:
        """(fold or held, keys..., pos, x), and the name of the fold column: fold when each held-out fold merges the others."""
        by = "fold" if self.plain else "held"
        return long_form(self.mapped(self.df) if self.plain else self.training(), [by, *keys]), by


def _held(view: View, stats: DataFrame) -> DataFrame:
    return stats.withColumnRenamed("fold", "held").filter(F.col("held").isin(view.instances)) if "held" not in stats.columns else stats


def moments_of(view: View, keys: list[str], condition: Column | None = None, value: Column | None = None) -> DataFrame:
    """(held, keys..., pos, n, s, m2) over the training rows of every held-out fold."""
    cells, by = view.cells(keys)
    cells = cells.filter(condition) if condition is not None else cells
    cells = cells.withColumn("x", value) if value is not None else cells
    stats = cells.groupBy(by, *keys, "pos").agg(F.count("x").alias("n"), F.sum("x").alias("s"), squared_deviations("x").alias("m2"))
    return _held(view, held_out_moments(stats, view.folds, [*keys, "pos"], "fold") if by == "fold" else stats).filter("n > 0")


def counts_of(view: View, keys: list[str], cells: DataFrame, by: str, measure: Column, name: str) -> DataFrame:
    """(held, keys..., name): sums over the training rows of every held-out fold."""
    stats = cells.groupBy(by, *keys).agg(measure.alias(name))
    return _held(view, held_out_complement(stats, view.folds, keys, [name], "fold") if by == "fold" else stats)


def class_sizes_of(view: View) -> DataFrame:
    """(held, label, n_c) of the training rows."""
    by = "held" if view.wide else "fold"
    rows = view.df.filter("fold <> held") if view.wide else view.df
    return counts_of(view, ["label"], rows, by, F.count(F.lit(1)), "n_c").filter("n_c > 0")


def _vectors(rows, instances: list[int], fields: list[str]) -> dict[int, dict[str, np.ndarray]]:
    """Collected rows (held, pos, fields...) as arrays per held-out fold."""
    width = {h: max((r["pos"] for r in rows if r["held"] == h), default=-1) + 1 for h in instances}
    out = {h: {f: np.full(width[h], np.nan) for f in fields} for h in instances}
    for r in rows:
        for f in fields:
            if r[f] is not None:
                out[r["held"]][f][r["pos"]] = r[f]
    return out


# ---------------------------------------------------------------- fitting a step for all folds

def _encode(columns: list[int], codes: list[np.ndarray], fraction: float | None, x: np.ndarray) -> np.ndarray:
    """One column per kept code of each categorical column, then the other columns."""
    out = []
    for c, kept in zip(columns, codes, strict=True):
        v = x[:, c]
        if np.any(v < 0):
            raise ValueError("categories must be non-negative integers")
        raw = np.where(np.isnan(v), CODE_MISSING, np.nan_to_num(v).astype(np.int64) + CODE_SHIFT)
        if fraction is not None:
            raw = np.where(np.isin(raw, kept), raw, CODE_OTHER)
        out.append((raw[:, None] == kept[None, :]).astype(np.float64))
    rest = [i for i in range(x.shape[1]) if i not in set(columns)]
    return np.concatenate([*out, x[:, rest]], axis=1)


def fit_one_hot(view: View, params: dict, categorical: list[int]) -> View:
    if not categorical:
        return view
    fraction = float(params["minimum_fraction"]) if _yes(params["use_minimum_fraction"]) else None
    cells, by = view.cells([])
    x = F.col("x")
    code = F.when(missing(x), CODE_MISSING).when(x < 0, F.raise_error(F.lit("ValueError: categories must be non-negative integers")).cast("bigint")).otherwise(x.cast("bigint") + CODE_SHIFT)
    cells = cells.filter(F.col("pos").isin(categorical)).withColumn("code", code.cast("bigint"))
    counts = counts_of(view, ["pos", "code"], cells, by, F.count(F.lit(1)), "cnt").filter("cnt > 0")
    total = counts.groupBy("held", "pos").agg(F.sum("cnt").alias("_total"))
    kept = F.lit(True) if fraction is None else F.col("cnt") / F.col("_total") >= fraction
    codes = counts.join(total, ["held", "pos"]).select("held", "pos", F.when(kept, F.col("code")).otherwise(F.lit(CODE_OTHER)).alias("code")).distinct()
    found: dict[tuple[int, int], list[int]] = {}
    for r in collect_bounded(codes, MAX_CATEGORIES, "categories"):
        found.setdefault((r["held"], r["pos"]), []).append(r["code"])
    return view.then({h: partial(_encode, categorical, [np.array(sorted(found.get((h, c), []))) for c in categorical], fraction) for h in view.instances})


def _fill(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), np.r_[values, np.full(x.shape[1] - len(values), np.nan)], x)


def fit_imputer(view: View, params: dict) -> View:
    strategy = params.get("strategy", "mean")
    present = ~missing(F.col("x"))
    if strategy == "mean":
        table = moments_of(view, [], present).select("held", "pos", (F.col("s") / F.col("n")).alias("value"))
    elif strategy == "most_frequent":
        cells, by = view.cells([])
        counts = counts_of(view, ["pos", "x"], cells.filter(present), by, F.count(F.lit(1)), "cnt").filter("cnt > 0")
        table = counts_mode(counts, ["held", "pos"], "x").withColumnRenamed("mode", "value")
    elif strategy == "median":
        cells = long_form(view.training(), ["held"]).filter(present)
        table = exact_median(cells, ["held", "pos"], "x").withColumnRenamed("median", "value")
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    rows = collect_bounded(table, MAX_COLUMNS * view.folds, "fill values")
    return view.then({h: partial(_fill, v["value"]) for h, v in _vectors(rows, view.instances, ["value"]).items()})


def _affine(shift: np.ndarray, scale: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (x - shift) / scale


def _unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1.0, norm)


def fit_rescaling(view: View, node: str) -> View:
    if node == "no_rescaling":
        return view
    if node == "normalize":
        return view.then(_unit_rows)
    if node == "standard_scaler":
        table = moments_of(view, []).select("held", "pos", (F.col("s") / F.col("n")).alias("a"), F.sqrt(F.col("m2") / F.col("n")).alias("b"))
    elif node == "minmax":
        cells, by = view.cells([])
        stats = cells.groupBy(by, "pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        if by == "fold":
            parts = stats.groupBy("pos").agg(F.collect_list(F.struct("fold", "lo", "hi")).alias("_p")).withColumn("held", F.explode(view._all_held()))
            others = F.filter("_p", lambda p: p["fold"] != F.col("held"))
            stats = parts.select("held", "pos", F.array_min(F.transform(others, lambda p: p["lo"])).alias("lo"), F.array_max(F.transform(others, lambda p: p["hi"])).alias("hi"))
        table = stats.select("held", "pos", F.col("lo").alias("a"), (F.col("hi") - F.col("lo")).alias("b"))
    else:
        raise ValueError(f"unknown rescaling: {node}")
    rows = collect_bounded(table, MAX_COLUMNS * view.folds, "scaler parameters")
    return view.then({h: partial(_affine, v["a"], np.where(v["b"] == 0, 1.0, v["b"])) for h, v in _vectors(rows, view.instances, ["a", "b"]).items()})


def fit_balancing(view: View, params: dict) -> View:
    """Features stay; ``weighting`` gives every class the weight (1 / n_c) / mean(1 / n_c) for classifiers that take weights."""
    if params.get("strategy", "none") == "none":
        return view
    sizes: dict[int, dict] = {}
    for r in collect_bounded(class_sizes_of(view), MAX_COLUMNS, "class sizes"):
        sizes.setdefault(r["held"], {})[r["label"]] = r["n_c"]
    return replace(view, weights={h: {c: (1 / n) / np.mean([1 / m for m in s.values()]) for c, n in s.items()} for h, s in sizes.items()})


def kept_by_percentile(score: np.ndarray, percentile: float) -> np.ndarray:
    """Positions above the (100 - percentile) quantile, then ties in column order up to the quota."""
    if percentile >= 100:
        return np.arange(len(score))
    value = np.where(np.isnan(score), np.finfo(np.float64).min, score)
    at, ordered = (len(value) - 1) * (1.0 - percentile / 100.0), np.sort(value)
    low, high = int(np.floor(at)), int(np.ceil(at))
    cut = ordered[low] if low == high or ordered[low] == ordered[high] else (high - at) * ordered[low] + (at - low) * ordered[high]
    rank = np.empty(len(value), dtype=np.int64)
    rank[np.lexsort((np.arange(len(value)), -value))] = np.arange(1, len(value) + 1)
    return np.flatnonzero((value > cut) | ((value == cut) & (rank <= np.floor(len(value) * percentile / 100.0))))


def kept_by_rate(pvalue: np.ndarray, alpha: float, mode: str) -> np.ndarray:
    """Positions passing a false-positive (fpr), family-wise (fwe) or false-discovery (fdr) level."""
    p = np.where(np.isnan(pvalue), np.inf, pvalue)
    if mode == "fpr":
        return np.flatnonzero(p < alpha)
    if mode == "fwe":
        return np.flatnonzero(p < alpha / len(p))
    if mode != "fdr":
        raise ValueError(f"unknown mode: {mode}")
    ordered = np.sort(p)
    passing = ordered[ordered <= alpha * np.arange(1, len(p) + 1) / len(p)]
    return np.flatnonzero(p <= passing.max()) if len(passing) else np.zeros(0, dtype=np.int64)


def _take(positions: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x[:, positions]


def _rotate(mean: np.ndarray, basis: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (x - mean) @ basis


def _scores_of(view: View, score_func: str) -> dict[int, dict[str, np.ndarray]]:
    if score_func == "chi2":
        table = chi2_from_moments(moments_of(view, ["label"], value=F.greatest("x", F.lit(0.0))), ["held"])
    else:
        table = f_from_moments(moments_of(view, ["label"]), ["held"])
    return _vectors(collect_bounded(table, MAX_COLUMNS * view.folds, "column scores"), view.instances, ["score", "pvalue"])


def _fit_pca(view: View, step: PCA) -> View:
    rows = collect_bounded(moments_of(view, []).select("held", "pos", "n", (F.col("s") / F.col("n")).alias("mean")), MAX_COLUMNS * view.folds, "column means")
    means = {h: v["mean"] for h, v in _vectors(rows, view.instances, ["mean"]).items()}
    if any(not np.all(np.isfinite(m)) for m in means.values()):
        raise ValueError("features must be finite")

    def gram(x: np.ndarray, key: tuple) -> np.ndarray:
        z = x - means[key[0]]
        return z.T @ z

    sums = partial_sums(view.training().select("held", "features"), ["held"], "features", gram, with_key=True)
    grams, fns = _grams(sums, {h: len(m) for h, m in means.items()}), {}
    for h in view.instances:
        n, g = grams[h]
        basis, _ = step.basis(*principal_axes(g / max(n - 1, 1)))
        fns[h] = partial(_rotate, means[h], basis)
    return view.then(fns)


def _grams(sums: DataFrame, widths: dict[int, int]) -> dict[int, tuple[int, np.ndarray]]:
    """(n, matrix) per held-out fold from the (held, i, n, j, s) rows of :func:`partial_sums`, matrix rows gathered by Spark."""
    if max(widths.values()) > MAX_GRAM_COLUMNS:
        raise ValueError(f"{max(widths.values())} columns are too many for a covariance matrix")
    lines = sums.groupBy("held", "i").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("j", "s"))), lambda e: e["s"]).alias("line"))
    out = {h: [0, np.zeros((d, d))] for h, d in widths.items()}
    for r in collect_bounded(lines, sum(widths.values()), "covariance"):
        out[r["held"]][0], out[r["held"]][1][r["i"]] = r["n"], r["line"]
    return {h: (n, g) for h, (n, g) in out.items()}


def fit_preprocessor(view: View, node: str, params: dict, run: _Run) -> View:
    if node == "no_preprocessing":
        return view
    if node in ("select_percentile", "select_rates"):
        scores = _scores_of(view, params["score_func"])
        if node == "select_percentile":
            kept = {h: kept_by_percentile(v["score"], float(params["percentile"])) for h, v in scores.items()}
        else:
            kept = {h: kept_by_rate(v["pvalue"], float(params["alpha"]), params["mode"]) for h, v in scores.items()}
        some = [h for h in view.instances if len(kept[h])]
        if not some:
            raise ValueError("every feature was removed")
        return replace(view, instances=some).then({h: partial(_take, kept[h]) for h in some})
    if node == "pca":
        return _fit_pca(view, _PREPROCESSORS[node](params))
    return _fit_each_fold(view, node, params, run)


def _fit_each_fold(view: View, node: str, params: dict, run: _Run) -> View:
    """Any other step: one fit per held-out fold on a stored table; the transformed rows of all folds are stored as one table."""
    stored = run.stored(view)

    def one(h: int) -> DataFrame:
        rows = stored.df.filter(F.col("held") == h)
        model = _PREPROCESSORS[node](params).fit(rows.filter("fold <> held").select("row_id", "features", "label"))
        return model.transform(rows).select("held", "row_id", "label", "fold", "features")

    parts = run.each_fold(one, view.instances)
    return run.stored(replace(stored, df=reduce(DataFrame.unionByName, parts.values()), instances=list(parts)), force=True)


# ---------------------------------------------------------------- the trie

@dataclass
class Node:
    """A step with its parameters behind the steps of its ancestors."""

    step: str
    node: str
    params: dict[str, str]
    parent: Node | None
    children: dict[tuple, Node] = field(default_factory=dict)
    members: list[int] = field(default_factory=list)  # configurations whose path passes here, in order
    ends: list[int] = field(default_factory=list)  # configurations whose last step before the classifier this is
    view: View | None = None
    seconds: float = 0.0
    stored: bool = False
    error: Exception | None = None

    @property
    def name(self) -> str:
        return f"{self.step}:{self.node}"

    def path(self) -> list[Node]:
        return [*(self.parent.path() if self.parent else []), self] if self.step else []


def build_trie(configs: list[dict[str, str]]) -> Node:
    """Root of the trie; two configurations share a node when all steps up to it agree after defaults are filled in."""
    root = Node("", "", {}, None)
    for i, config in enumerate(configs):
        at = root
        for step in CONSTANT_STEPS:
            node, params = parameters(config, step)
            key = (node, tuple(sorted(params.items())))
            at = at.children.setdefault(key, Node(step, node, params, at))
            at.members.append(i)
        at.ends.append(i)
    return root


@dataclass
class _Run:
    """Scratch folder and settings of one evaluation."""

    folder: str
    parallelism: int
    categorical: list[int]
    minimum_seconds: float

    def stored(self, view: View, force: bool = False) -> View:
        """The view as a table with one row per held-out fold."""
        if view.wide and not view.chain and not force:
            return view
        return replace(view, df=self.table(view.whole().select("held", "row_id", "label", "fold", "features")), wide=True, chain=())

    def table(self, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def each_fold(self, fn: Callable[[int], DataFrame], instances: list[int]) -> dict[int, DataFrame]:
        """``fn`` of every held-out fold; folds in which it raises ValueError are left out, unless all do."""

        def guarded(h: int) -> DataFrame | Exception:
            try:
                return fn(h)
            except Exception as error:
                if not _value_error(error):
                    raise
                return error

        with ThreadPoolExecutor(self.parallelism) as pool:
            out = dict(zip(instances, pool.map(guarded, instances), strict=True))
        good = {h: df for h, df in out.items() if not isinstance(df, Exception)}
        if not good:
            raise next(iter(out.values()))
        return good


def _value_error(error: Exception) -> bool:
    """A ValueError of the driver, or one that a task's Python worker or expression raised."""
    if isinstance(error, ValueError):
        return True
    lines = str(error).splitlines()
    return any(line.strip().startswith(("ValueError:", "[USER_RAISED_EXCEPTION] ValueError:")) for line in lines)


def _fit_node(node: Node, run: _Run) -> None:
    """Fit the node's step on its parent's view; store the result if that pays."""
    if node.parent.error is not None:
        node.error = node.parent.error
        return
    started, view = time.time(), node.parent.view
    try:
        if node.step == "one_hot_encoder":
            node.view = fit_one_hot(view, node.params, run.categorical)
        elif node.step == "imputation":
            node.view = fit_imputer(view, node.params)
        elif node.step == "rescaling":
            node.view = fit_rescaling(view, node.node)
        elif node.step == "balancing":
            node.view = fit_balancing(view, node.params)
        else:
            node.view = fit_preprocessor(view, node.node, node.params, run)
        node.seconds = time.time() - started
        if node.step in CACHED_STEPS and len(node.children) + len(node.ends) > 1 and node.seconds > run.minimum_seconds:
            node.view = run.stored(node.view)
        node.stored = node.view.wide and not node.view.chain and node.view is not view
        node.seconds = time.time() - started
    except Exception as error:
        if not _value_error(error):
            raise
        node.seconds, node.error = time.time() - started, error


# ---------------------------------------------------------------- classifiers

_BAYES = {"gaussian_nb": "gaussian", "multinomial_nb": "multinomial", "bernoulli_nb": "bernoulli"}


def _bayes(view: View, kind: str, alpha: float, fit_prior: bool) -> DataFrame:
    """Predictions of all folds from one pass over the training rows and one over the held-out rows."""
    sizes = class_sizes_of(view)
    if kind == "gaussian":
        stats = gaussian_from_sums(moments_of(view, ["label"]), ["held"], "label")
    else:
        cells, by = view.cells(["label"])
        measure = F.sum(F.greatest("x", F.lit(0.0))) if kind == "multinomial" else F.sum((F.col("x") > 0).cast("bigint"))
        counts = counts_of(view, ["label", "pos"], cells, by, measure, "n_cj").join(sizes.select("held", "label"), ["held", "label"])
        stats = multinomial_from_counts(counts, ["held"], "label", alpha) if kind == "multinomial" else bernoulli_from_counts(counts, sizes, ["held"], "label", alpha)
    return naive_bayes_model(kind, stats, sizes, "label", "features", "held", fit_prior).predict(view.held_out())


def _predictions(view: View, config: dict[str, str], run: _Run) -> dict[int, DataFrame]:
    """Stored predictions (held, label, prediction) by held-out fold; folds whose fit raises ValueError are absent."""
    node, params = parameters(config, "classifier")
    if node in _BAYES:
        out = run.table(_bayes(view, _BAYES[node], float(params.get("alpha", 1.0)), _yes(params.get("fit_prior", "True"))).select("held", "label", "prediction"))
        return {h: out.filter(F.col("held") == h) for h in view.instances}
    ready = view if view.plain or (view.wide and not view.chain) else run.stored(view)

    def one(h: int) -> DataFrame:
        part = replace(ready, instances=[h])
        train, held = part.training().filter(F.col("held") == h), part.held_out().filter(F.col("held") == h)
        model = classifier_of(config)
        if view.weights and hasattr(model, "weight"):
            model.weight = "weight"
            each = F.create_map(*[F.lit(v) for c, w in view.weights[h].items() for v in (c, float(w))])
            train = train.withColumn("weight", F.element_at(each, F.col("label")))
        return model.fit(train.drop("fold", "held")).predict(held.select("row_id", "features", "label", "fold", "held"))

    return run.each_fold(lambda h: run.table(one(h).select("held", "label", "prediction")), view.instances)


# ---------------------------------------------------------------- evaluation

def evaluate_trie(
    rows: DataFrame,
    configs: list[tuple[str, dict[str, str]]],
    k_classes: int,
    folds: int,
    instances: list[int] | None = None,
    categorical: list[int] | None = None,
    minimum_seconds: float = MIN_STAGE_SECONDS,
    stamp: str = "batch",
    parallelism: int = 4,
) -> DataFrame:
    """One run record per configuration and held-out fold: the fields of a run log, with config_id, status and prefix_hits.

    ``rows`` has row_id, features, label and fold (0..folds-1); ``categorical`` are the positions that one-hot encoding replaces.  A
    step or classifier that raises ValueError fails the runs below it (status CRASHED, the failure cost).  ``cache_hits`` and
    ``total_evaluations`` count, over the runs so far, the cached steps that another configuration had fitted, and all cached steps;
    ``runtime`` holds a run's share of the steps that it was the first to need and of its classifier, ``runtime_reduction_by_caching``
    its share of the seconds of the steps it found.  Scratch tables are dropped at the end.
    """
    spark = rows.sparkSession
    held = sorted(instances) if instances is not None else list(range(folds))
    checkpoint_root(spark)
    run = _Run(scratch_path(spark, "trie"), parallelism, sorted(categorical or []), minimum_seconds)
    root = build_trie([c for _, c in configs])
    base = rows.select("row_id", "label", F.col("fold").cast("int").alias("fold"), doubles("features").alias("features"))
    root.view = View(base, folds, held)
    level, started = list(root.children.values()), time.time()
    with ThreadPoolExecutor(parallelism) as pool:
        while level:
            list(pool.map(lambda n: _fit_node(n, run), level))
            level = [c for n in level for c in n.children.values()]

    leaves = {i: n for n in _nodes(root) for i in n.ends}

    def score(i: int) -> tuple[dict[int, DataFrame], float]:
        began, leaf = time.time(), leaves[i]
        if leaf.error is not None:
            return {}, 0.0
        try:
            return _predictions(leaf.view, configs[i][1], run), time.time() - began
        except Exception as error:
            if not _value_error(error):
                raise
            return {}, time.time() - began

    with ThreadPoolExecutor(parallelism) as pool:
        outcome = list(pool.map(score, range(len(configs))))
    costs: dict[tuple[int, int], float] = {}
    tables = [df.withColumn("i", F.lit(i)) for i, (by_fold, _) in enumerate(outcome) for df in by_fold.values()]
    for at in range(0, len(tables), UNION_TABLES):
        scored = reduce(DataFrame.unionByName, tables[at : at + UNION_TABLES])
        bac = bac_multiclass(scored, "label", "prediction", k_classes, ["i", "held"])
        costs |= {(r["i"], r["held"]): 1.0 - r["bac"] for r in collect_bounded(bac, UNION_TABLES, "costs")}
    records = _records(configs, leaves, outcome, costs, held, stamp)
    folder = spark._jvm.org.apache.hadoop.fs.Path(run.folder)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    schema = T.StructType([*RUN_SCHEMA.fields, T.StructField("config_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("prefix_hits", T.IntegerType())])
    return spark.createDataFrame(records, schema)


def _nodes(node: Node) -> list[Node]:
    return [node, *(m for c in node.children.values() for m in _nodes(c))]


def _records(configs, leaves, outcome, costs, held, stamp) -> list[tuple]:
    out, hits, total, wall, share = [], 0, 0, 0.0, 1.0 / max(1, len(held))
    for i, (config_id, config) in enumerate(configs):
        path = leaves[i].path()
        cached = [n for n in path if n.step in CACHED_STEPS]
        found = [n for n in cached if n.members[0] != i]
        own = {n.name: n.seconds * share for n in path if n.members[0] == i}
        seconds = outcome[i][1]
        own[f"classifier:{config['classifier:__choice__']}"] = seconds * share
        for h in held:
            hits, total, wall = hits + len(found), total + len(cached), wall + sum(own.values())
            cost, status = costs.get((i, h), FAILED_COST), "SUCCESS" if (i, h) in costs else "CRASHED"
            saved = sum(n.seconds for n in found) * share
            out.append((stamp, len(out) + 1, h, cost, sum(own.values()), own, hits, total, saved, wall, {k: v for k, v in config.items() if v is not None}, "trie", config_id, status, len(found)))
    return out
