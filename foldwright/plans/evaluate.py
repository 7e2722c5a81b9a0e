"""Fit and score configurations on folds, computing every shared preprocessing prefix once.

The prediction table (config_id, fold, row_id, label, prediction) of all configurations is scored
in one aggregation.  The loop over configurations on the driver only submits jobs; the number of
configurations is bounded, the rows never leave the tasks.
"""

from __future__ import annotations

import time
import uuid
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.functions.constants import FAILED_COST
from foldwright.functions.exprs import to_float32
from foldwright.operators import agglomerate, discriminant, linear, naive_bayes, neighbors, project, select, tabular, trees
from foldwright.operators.folds import fold_split
from foldwright.operators.metrics import bac_multiclass
from foldwright.operators.steps import FeatureStep, Identity
from foldwright.plans.candidates import sample_candidates
from foldwright.plans.space import CONSTANT_STEPS, PARAMS
from foldwright.session import collect_bounded, scratch_path

MAX_CANDIDATES = 10_000


# ---------------------------------------------------------------- configurations to steps

def parameters(config: dict[str, str], step: str) -> tuple[str, dict[str, str]]:
    """(chosen node, its parameters with the defaults filled in)."""
    node = config[f"{step}:__choice__"]
    out = {p.name: p.default for p in PARAMS if (p.step, p.node) == (step, node)}
    prefix = f"{step}:{node}:"
    out.update({k[len(prefix):]: v for k, v in config.items() if k.startswith(prefix) and v is not None})
    return node, out


def _yes(text: str) -> bool:
    return str(text).strip().lower() == "true"


def _depth(text: str, default: int) -> int:
    return default if text in (None, "None") else int(text)


_PREPROCESSORS = {
    "extra_rand_trees": lambda p: select.TreeSelect(criterion=p["criterion"], max_features=float(p["max_features"]), min_samples_split=p["min_samples_split"], min_samples_leaf=p["min_samples_leaf"], bootstrap=_yes(p["bootstrap"]), max_depth=_depth(p["max_depth"], 10)),
    "fast_ica": lambda p: project.FastICA(int(p["n_components"]), p["algorithm"], _yes(p["whiten"]), p["fun"]),
    "feature_agglomeration": lambda p: agglomerate.FeatureAgglomeration(int(p["n_clusters"]), p["affinity"], p["linkage"], p["pooling_func"]),
    "kernel_pca": lambda p: project.KernelPCA(int(p["n_components"]), p["kernel"], float(p["gamma"]), int(p["degree"]), float(p["coef0"])),
    "kitchen_sinks": lambda p: project.KitchenSinks(float(p["gamma"]), int(p["n_components"])),
    "linear_svm": lambda p: select.LinearSelect(float(p["C"]), float(p["tol"]), p["loss"], p["penalty"]),
    "no_preprocessing": lambda p: Identity(),
    "nystroem_sampler": lambda p: project.Nystroem(p["kernel"], int(p["n_components"]), float(p["gamma"]), int(p["degree"]), float(p["coef0"])),
    "pca": lambda p: project.PCA(float(p["keep_variance"]), _yes(p["whiten"])),
    "polynomial_features": lambda p: project.PolynomialFeatures(int(p["degree"]), _yes(p["interaction_only"]), _yes(p["include_bias"])),
    "random_trees_embedding": lambda p: trees.RandomTreesEmbedding(p["n_estimators"], p["max_depth"], p["min_samples_split"], p["min_samples_leaf"]),
    "select_percentile": lambda p: select.SelectPercentile(float(p["percentile"]), p["score_func"]),
    "select_rates": lambda p: select.SelectRates(float(p["alpha"]), p["score_func"], p["mode"]),
}
_RESCALERS = {
    "standard_scaler": tabular.StandardScaler,
    "minmax": tabular.MinMaxScaler,
    "no_rescaling": Identity,
    "normalize": tabular.RowNormalizer,
}


class _Bayes(linear.Classifier):
    def __init__(self, kind: str, alpha: float = 1.0, fit_prior: bool = True, **kw):
        super().__init__(**kw)
        self.kind, self.alpha, self.fit_prior = kind, alpha, fit_prior

    def fit(self, df: DataFrame):
        return naive_bayes.fit_naive_bayes(df, self.kind, self.label, self.features, self.alpha, self.fit_prior)


_CLASSIFIERS = {
    "adaboost": lambda p: trees.AdaBoost(p["n_estimators"], p["learning_rate"], p["algorithm"], p["max_depth"]),
    "bernoulli_nb": lambda p: _Bayes("bernoulli", float(p["alpha"]), _yes(p["fit_prior"])),
    "decision_tree": lambda p: trees.DecisionTree(p["criterion"], p["max_depth"], p["min_samples_split"], p["min_samples_leaf"]),
    "extra_trees": lambda p: trees.ExtraTrees(criterion=p["criterion"], max_features=p["max_features"], min_samples_split=p["min_samples_split"], min_samples_leaf=p["min_samples_leaf"], bootstrap=_yes(p["bootstrap"])),
    "gaussian_nb": lambda p: _Bayes("gaussian"),
    "gradient_boosting": lambda p: trees.GradientBoosting(p["learning_rate"], p["n_estimators"], p["max_depth"], p["min_samples_split"], p["min_samples_leaf"], p["subsample"], p["max_features"]),
    "k_nearest_neighbors": lambda p: neighbors.KNeighbors(p["n_neighbors"], p["weights"], p["p"]),
    "lda": lambda p: discriminant.LDA(p["shrinkage"], p["shrinkage_factor"], p["n_components"], p["tol"]),
    "liblinear_svc": lambda p: linear.LinearSVM(p["C"], p["tol"], p["penalty"], p["loss"]),
    "libsvm_svc": lambda p: linear.KernelSVM(p["C"], p["kernel"], p["degree"], float(p["gamma"]), p["coef0"], _yes(p["shrinking"]), p["tol"]),
    "multinomial_nb": lambda p: _Bayes("multinomial", float(p["alpha"]), _yes(p["fit_prior"])),
    "passive_aggresive": lambda p: linear.PassiveAggressive(p["C"], p["loss"], p["n_iter"]),
    "qda": lambda p: discriminant.QDA(p["reg_param"]),
    "random_forest": lambda p: trees.RandomForest(criterion=p["criterion"], max_features=p["max_features"], min_samples_split=p["min_samples_split"], min_samples_leaf=p["min_samples_leaf"], bootstrap=_yes(p["bootstrap"])),
    "sgd": lambda p: linear.SGD(p["loss"], p["penalty"], p["alpha"], p["l1_ratio"], p["n_iter"], p["learning_rate"], p["eta0"], p["power_t"], _yes(p["average"]), p["epsilon"]),
}


def register_preprocessor(name: str, make) -> None:
    """Add a node: ``make(parameters)`` returns a :class:`FeatureStep`."""
    _PREPROCESSORS[name] = make


def register_classifier(name: str, make) -> None:
    """Add a node: ``make(parameters)`` returns a classifier with ``fit``."""
    _CLASSIFIERS[name] = make


def feature_steps(config: dict[str, str]) -> list[tuple[str, FeatureStep]]:
    """The steps before the classifier.

    One-hot encoding has no categorical columns here and balancing keeps every row, so both leave
    the features alone.
    """
    _, imputation = parameters(config, "imputation")
    rescaling, _ = parameters(config, "rescaling")
    node, params = parameters(config, "feature_preprocessor")
    return [
        ("imputation", tabular.Imputer(imputation.get("strategy", "mean"))),
        ("rescaling", _RESCALERS[rescaling]()),
        ("feature_preprocessor", _PREPROCESSORS[node](params)),
    ]


def classifier_of(config: dict[str, str]) -> linear.Classifier:
    node, params = parameters(config, "classifier")
    return _CLASSIFIERS[node](params)


# ---------------------------------------------------------------- evaluation

def _only_value_errors(error: Exception) -> None:
    """A ValueError raised inside a task arrives wrapped; anything else is a defect and goes on."""
    if not isinstance(error, ValueError) and "ValueError" not in str(error):
        raise error


def _prefix(config: dict[str, str]) -> tuple:
    return tuple(sorted((k, v) for k, v in config.items() if k.split(":")[0] in CONSTANT_STEPS and v is not None))


def apply_prefix(train: DataFrame, held: DataFrame, config: dict[str, str], path: str) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """Fit the steps on the training rows and store both transformed parts, narrowed to float32.

    The stored table cuts the lineage: every classifier of the prefix reads it, and a lost executor
    re-reads it.
    """
    timing = {}
    a, b = train.select("row_id", "features", "label"), held.select("row_id", "features", "label")
    for name, step in feature_steps(config):
        started = time.time()
        model = step.fit(a)
        a, b = model.transform(a).select("row_id", "features", "label"), model.transform(b).select("row_id", "features", "label")
        timing[name] = time.time() - started
    started = time.time()
    both = a.withColumn("held", F.lit(False)).unionByName(b.withColumn("held", F.lit(True)))
    both.withColumn("features", to_float32("features")).write.mode("overwrite").parquet(path)
    stored = train.sparkSession.read.parquet(path)
    timing["store"] = time.time() - started
    return stored.filter(~F.col("held")).drop("held"), stored.filter("held").drop("held"), timing


def evaluate(
    rows: DataFrame,
    configs: list[tuple[str, dict[str, str]]],
    k_classes: int,
    folds: int,
    instances: list[int] | None = None,
    share_prefix: bool = True,
    parallelism: int = 4,
) -> DataFrame:
    """(config_id, fold, cost, status, prefix_hit, seconds, steps) for rows with a ``fold`` column.

    ``share_prefix=False`` recomputes the preprocessing for every configuration; the costs are the
    same.  A configuration whose fit raises ValueError gets the failure cost.
    """
    spark = rows.sparkSession
    predictions = scratch_path(spark, "predictions")
    runs: list[tuple] = []

    def score(config_id: str, config: dict, fold: int, train: DataFrame, held: DataFrame) -> tuple[str, float]:
        started = time.time()
        try:
            out = classifier_of(config).fit(train).predict(held)
            # concurrent jobs must not commit into one folder, so every run has its own partition
            out.select(F.lit(config_id).alias("config_id"), F.lit(fold).alias("fold"), "row_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).write.parquet(f"{predictions}/run={uuid.uuid4().hex}")
            return "SUCCESS", time.time() - started
        except (ValueError, PythonException) as error:
            _only_value_errors(error)
            return "CRASHED", time.time() - started

    def run_group(task: tuple[int, list]) -> list[tuple]:
        fold, members = task
        train, held = fold_split(rows, fold, folds)
        try:
            a, b, timing = apply_prefix(train, held, members[0][1], scratch_path(spark, "prefix"))
        except (ValueError, PythonException) as error:
            _only_value_errors(error)
            return [(c, fold, "CRASHED", False, 0.0, {}) for c, _ in members]
        with ThreadPoolExecutor(parallelism) as pool:
            done = list(pool.map(lambda m: score(m[0], m[1], fold, a, b), members))
        out = []
        for i, ((config_id, _), (status, seconds)) in enumerate(zip(members, done)):
            own = {**timing, "classifier": seconds} if i == 0 else {"classifier": seconds}
            out.append((config_id, fold, status, i > 0, float(sum(own.values())), own))
        return out

    groups: dict[tuple, list] = defaultdict(list)
    for config_id, config in configs:
        groups[_prefix(config) if share_prefix else (config_id,)].append((config_id, config))
    held_out = instances if instances is not None else list(range(folds))
    with ThreadPoolExecutor(parallelism) as pool:
        for done in pool.map(run_group, [(fold, members) for fold in held_out for members in groups.values()]):
            runs += done

    log = spark.createDataFrame(runs, "config_id string, fold int, status string, prefix_hit boolean, seconds double, steps map<string,double>")
    if not any(r[2] == "SUCCESS" for r in runs):
        return log.withColumn("cost", F.lit(FAILED_COST))
    bac = bac_multiclass(spark.read.parquet(predictions), "label", "prediction", k_classes, ["config_id", "fold"])
    cost = F.when(F.col("status") == "SUCCESS", F.lit(1.0) - F.col("bac")).otherwise(F.lit(FAILED_COST))
    return log.join(bac, ["config_id", "fold"], "left").withColumn("cost", cost).drop("bac")


def collect_configs(candidates: DataFrame, limit: int = MAX_CANDIDATES) -> list[tuple[str, dict[str, str]]]:
    rows = collect_bounded(candidates.select("config_id", "config"), limit, "candidates")
    return [(r["config_id"], dict(r["config"])) for r in rows]


def test_error(train: DataFrame, test: DataFrame, config: dict[str, str], k_classes: int) -> float:
    """Error on the test rows after fitting on all training rows; 1 when the fit fails."""
    both = train.withColumn("fold", F.lit(1)).unionByName(test.withColumn("fold", F.lit(0)))
    row = evaluate(both, [("test", config)], k_classes, 2, [0]).first()
    return 1.0 if row["status"] != "SUCCESS" else row["cost"]


test_error.__test__ = False  # not a test function


def random_search(
    rows: DataFrame, n: int, k_classes: int, folds: int, seed: int = 1, instances: list[int] | None = None, preprocessors=None, classifiers=None
) -> DataFrame:
    """Run log of n drawn configurations evaluated as one batch job, numbered in drawing order."""
    drawn = sample_candidates(rows.sparkSession, n, seed, preprocessors, classifiers)
    order = drawn.select("config_id", F.col("id").alias("drawn"))
    log = evaluate(rows, collect_configs(drawn.dropDuplicates(["config_id"])), k_classes, folds, instances or [min(1, folds - 1)])
    return log.join(order.groupBy("config_id").agg(F.min("drawn").alias("drawn")), "config_id")
