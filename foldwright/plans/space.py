"""The steps, nodes, hyperparameters and forbidden pairs a configuration is drawn from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: steps in order, and whether their output is shared between configurations
STEPS = [
    ("one_hot_encoder", False),
    ("imputation", True),
    ("rescaling", False),
    ("balancing", False),
    ("feature_preprocessor", True),
    ("classifier", False),
]
STEP_NAMES = [s for s, _ in STEPS]
CONSTANT_STEPS = STEP_NAMES[:-1]
VARIABLE_STEPS = STEP_NAMES[-1:]

# --- fixed values: step, node, what it accepts, what it gives
NODES = [
    ("one_hot_encoder", "one_hot_encoding", ["DENSE", "SPARSE", "UNSIGNED"], ["INPUT"]),
    ("imputation", "imputer", ["DENSE", "SPARSE", "UNSIGNED"], ["INPUT"]),
    ("rescaling", "standard_scaler", ["DENSE", "SPARSE", "UNSIGNED"], ["INPUT"]),
    ("rescaling", "minmax", ["DENSE", "UNSIGNED"], ["INPUT", "SIGNED"]),
    ("rescaling", "no_rescaling", ["DENSE", "SPARSE", "UNSIGNED"], ["INPUT"]),
    ("rescaling", "normalize", ["DENSE", "SPARSE", "UNSIGNED"], ["INPUT"]),
    ("balancing", "balancer", ["DENSE", "SPARSE", "UNSIGNED", "SIGNED"], ["INPUT"]),
    ("feature_preprocessor", "extra_rand_trees", ["DENSE", "SPARSE", "UNSIGNED"], ["INPUT"]),
    ("feature_preprocessor", "fast_ica", ["DENSE", "UNSIGNED"], ["INPUT", "UNSIGNED"]),
    ("feature_preprocessor", "feature_agglomeration", ["DENSE", "UNSIGNED"], ["INPUT"]),
    ("feature_preprocessor", "kernel_pca", ["DENSE", "SPARSE", "UNSIGNED"], ["DENSE", "UNSIGNED"]),
    ("feature_preprocessor", "kitchen_sinks", ["DENSE", "SPARSE", "UNSIGNED"], ["INPUT", "UNSIGNED"]),
    ("feature_preprocessor", "linear_svm", ["DENSE", "SPARSE", "UNSIGNED"], ["INPUT"]),
    ("feature_preprocessor", "no_preprocessing", ["DENSE", "SPARSE", "UNSIGNED"], ["INPUT"]),
    ("feature_preprocessor", "nystroem_sampler", ["DENSE", "SPARSE", "UNSIGNED"], ["INPUT", "UNSIGNED"]),
    ("feature_preprocessor", "pca", ["DENSE", "UNSIGNED"], ["DENSE", "UNSIGNED"]),
    ("feature_preprocessor", "polynomial_features", ["DENSE", "UNSIGNED"], ["INPUT"]),
    ("feature_preprocessor", "random_trees_embedding", ["DENSE", "SPARSE", "UNSIGNED"], ["SPARSE", "SIGNED"]),
    ("feature_preprocessor", "select_percentile", ["DENSE", "SPARSE", "UNSIGNED"], ["INPUT"]),
    ("feature_preprocessor", "select_rates", ["DENSE", "SPARSE", "UNSIGNED"], ["INPUT"]),
    ("classifier", "adaboost", ["DENSE", "SPARSE", "UNSIGNED"], ["PREDICTIONS"]),
    ("classifier", "bernoulli_nb", ["DENSE", "SPARSE", "UNSIGNED"], ["PREDICTIONS"]),
    ("classifier", "decision_tree", ["DENSE", "SPARSE", "UNSIGNED"], ["PREDICTIONS"]),
    ("classifier", "extra_trees", ["DENSE", "SPARSE", "UNSIGNED"], ["PREDICTIONS"]),
    ("classifier", "gaussian_nb", ["DENSE", "UNSIGNED"], ["PREDICTIONS"]),
    ("classifier", "gradient_boosting", ["DENSE", "UNSIGNED"], ["PREDICTIONS"]),
    ("classifier", "k_nearest_neighbors", ["DENSE", "SPARSE", "UNSIGNED"], ["PREDICTIONS"]),
    ("classifier", "lda", ["DENSE", "UNSIGNED"], ["PREDICTIONS"]),
    ("classifier", "liblinear_svc", ["DENSE", "SPARSE", "UNSIGNED"], ["PREDICTIONS"]),
    ("classifier", "libsvm_svc", ["DENSE", "SPARSE", "UNSIGNED"], ["PREDICTIONS"]),
    ("classifier", "multinomial_nb", ["DENSE", "SPARSE", "SIGNED"], ["PREDICTIONS"]),
    ("classifier", "passive_aggresive", ["DENSE", "SPARSE", "UNSIGNED"], ["PREDICTIONS"]),
    ("classifier", "qda", ["DENSE", "UNSIGNED"], ["PREDICTIONS"]),
    ("classifier", "random_forest", ["DENSE", "SPARSE", "UNSIGNED"], ["PREDICTIONS"]),
    ("classifier", "sgd", ["DENSE", "SPARSE", "UNSIGNED"], ["PREDICTIONS"]),
]


@dataclass(frozen=True)
class Param:
    """kind is ``float``, ``int`` or ``cat``; a parent makes the parameter active only for some of its values."""

    step: str
    node: str
    name: str
    kind: str
    low: float | None = None
    high: float | None = None
    log: bool = False
    choices: tuple[str, ...] = ()
    default: str | None = None
    parent: str | None = None
    parent_values: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.step}:{self.node}:{self.name}"


def _f(step, node, name, low, high, default, log=False, parent=None, values=()):
    return Param(step, node, name, "float", low, high, log, (), str(default), parent, tuple(values))


def _i(step, node, name, low, high, default, log=False, parent=None, values=()):
    return Param(step, node, name, "int", low, high, log, (), str(default), parent, tuple(values))


def _c(step, node, name, choices, default, parent=None, values=()):
    return Param(step, node, name, "cat", None, None, False, tuple(choices), default, parent, tuple(values))


_FP, _CL = "feature_preprocessor", "classifier"
_BOOL = ("True", "False")
_GAMMA = 3.0517578125e-05

# --- fixed values: hyperparameter ranges, defaults and activation conditions
PARAMS = [
    _c("one_hot_encoder", "one_hot_encoding", "use_minimum_fraction", _BOOL, "True"),
    _f("one_hot_encoder", "one_hot_encoding", "minimum_fraction", 0.0001, 0.5, 0.01, True, "use_minimum_fraction", ["True"]),
    _c("imputation", "imputer", "strategy", ["mean", "median", "most_frequent"], "mean"),
    _c("balancing", "balancer", "strategy", ["none", "weighting"], "none"),
    _c(_FP, "extra_rand_trees", "criterion", ["gini", "entropy"], "gini"),
    _f(_FP, "extra_rand_trees", "max_features", 0.5, 5, 1),
    _c(_FP, "extra_rand_trees", "max_depth", ["None"], "None"),
    _i(_FP, "extra_rand_trees", "min_samples_split", 2, 20, 2),
    _i(_FP, "extra_rand_trees", "min_samples_leaf", 1, 20, 1),
    _c(_FP, "extra_rand_trees", "bootstrap", _BOOL, "False"),
    _i(_FP, "fast_ica", "n_components", 10, 2000, 100, False, "whiten", ["True"]),
    _c(_FP, "fast_ica", "algorithm", ["parallel", "deflation"], "parallel"),
    _c(_FP, "fast_ica", "whiten", ["False", "True"], "False"),
    _c(_FP, "fast_ica", "fun", ["logcosh", "exp", "cube"], "logcosh"),
    _i(_FP, "feature_agglomeration", "n_clusters", 2, 400, 25),
    _c(_FP, "feature_agglomeration", "affinity", ["euclidean", "manhattan", "cosine"], "euclidean"),
    _c(_FP, "feature_agglomeration", "linkage", ["ward", "complete", "average"], "ward"),
    _c(_FP, "feature_agglomeration", "pooling_func", ["mean", "median", "max"], "mean"),
    _i(_FP, "kernel_pca", "n_components", 10, 2000, 100),
    _c(_FP, "kernel_pca", "kernel", ["poly", "rbf", "sigmoid", "cosine"], "rbf"),
    _i(_FP, "kernel_pca", "degree", 2, 5, 3, False, "kernel", ["poly"]),
    _f(_FP, "kernel_pca", "gamma", _GAMMA, 8, 1.0, True, "kernel", ["poly", "rbf"]),
    _f(_FP, "kernel_pca", "coef0", -1, 1, 0, False, "kernel", ["poly", "sigmoid"]),
    _f(_FP, "kitchen_sinks", "gamma", 0.3, 2.0, 1.0),
    _i(_FP, "kitchen_sinks", "n_components", 50, 10000, 100, True),
    _c(_FP, "linear_svm", "penalty", ["l1"], "l1"),
    _c(_FP, "linear_svm", "loss", ["hinge", "squared_hinge"], "squared_hinge"),
    _f(_FP, "linear_svm", "tol", 1e-5, 1e-1, 1e-4, True),
    _f(_FP, "linear_svm", "C", 0.03125, 32768, 1.0, True),
    _c(_FP, "linear_svm", "multi_class", ["ovr"], "ovr"),
    _c(_FP, "linear_svm", "fit_intercept", ["True"], "True"),
    _c(_FP, "nystroem_sampler", "kernel", ["poly", "rbf", "sigmoid", "cosine", "chi2"], "rbf"),
    _i(_FP, "nystroem_sampler", "degree", 2, 5, 3, False, "kernel", ["poly"]),
    _f(_FP, "nystroem_sampler", "gamma", _GAMMA, 8, 0.1, True, "kernel", ["poly", "rbf", "sigmoid", "chi2"]),
    _f(_FP, "nystroem_sampler", "coef0", -1, 1, 0, False, "kernel", ["poly", "sigmoid"]),
    _i(_FP, "nystroem_sampler", "n_components", 50, 10000, 100, True),
    _f(_FP, "pca", "keep_variance", 0.5, 0.9999, 0.9999),
    _c(_FP, "pca", "whiten", ["False", "True"], "False"),
    _i(_FP, "polynomial_features", "degree", 2, 3, 2),
    _c(_FP, "polynomial_features", "interaction_only", ["False", "True"], "False"),
    _c(_FP, "polynomial_features", "include_bias", _BOOL, "True"),
    _i(_FP, "random_trees_embedding", "n_estimators", 10, 100, 10),
    _i(_FP, "random_trees_embedding", "max_depth", 2, 10, 5),
    _i(_FP, "random_trees_embedding", "min_samples_split", 2, 20, 2),
    _i(_FP, "random_trees_embedding", "min_samples_leaf", 1, 20, 1),
    _c(_FP, "random_trees_embedding", "max_leaf_nodes", ["None"], "None"),
    _f(_FP, "select_percentile", "percentile", 1, 99, 50),
    _c(_FP, "select_percentile", "score_func", ["chi2", "f_classif"], "chi2"),
    _f(_FP, "select_rates", "alpha", 0.01, 0.5, 0.1),
    _c(_FP, "select_rates", "score_func", ["chi2", "f_classif"], "chi2"),
    _c(_FP, "select_rates", "mode", ["fpr", "fdr", "fwe"], "fpr"),
    _i(_CL, "adaboost", "n_estimators", 50, 500, 50),
    _f(_CL, "adaboost", "learning_rate", 0.01, 2, 0.1, True),
    _c(_CL, "adaboost", "algorithm", ["SAMME.R", "SAMME"], "SAMME.R"),
    _i(_CL, "adaboost", "max_depth", 1, 10, 1),
    _f(_CL, "bernoulli_nb", "alpha", 1e-2, 100, 1, True),
    _c(_CL, "bernoulli_nb", "fit_prior", _BOOL, "True"),
    _c(_CL, "decision_tree", "criterion", ["gini", "entropy"], "gini"),
    _f(_CL, "decision_tree", "max_depth", 0.0, 2.0, 0.5),
    _i(_CL, "decision_tree", "min_samples_split", 2, 20, 2),
    _i(_CL, "decision_tree", "min_samples_leaf", 1, 20, 1),
    _c(_CL, "extra_trees", "criterion", ["gini", "entropy"], "gini"),
    _f(_CL, "extra_trees", "max_features", 0.5, 5, 1),
    _i(_CL, "extra_trees", "min_samples_split", 2, 20, 2),
    _i(_CL, "extra_trees", "min_samples_leaf", 1, 20, 1),
    _c(_CL, "extra_trees", "bootstrap", _BOOL, "False"),
    _f(_CL, "gradient_boosting", "learning_rate", 0.01, 1, 0.1, True),
    _i(_CL, "gradient_boosting", "n_estimators", 50, 500, 100),
    _i(_CL, "gradient_boosting", "max_depth", 1, 10, 3),
    _i(_CL, "gradient_boosting", "min_samples_split", 2, 20, 2),
    _i(_CL, "gradient_boosting", "min_samples_leaf", 1, 20, 1),
    _f(_CL, "gradient_boosting", "subsample", 0.01, 1.0, 1.0),
    _f(_CL, "gradient_boosting", "max_features", 0.5, 5, 1),
    _i(_CL, "k_nearest_neighbors", "n_neighbors", 1, 100, 1, True),
    _c(_CL, "k_nearest_neighbors", "weights", ["uniform", "distance"], "uniform"),
    _i(_CL, "k_nearest_neighbors", "p", 1, 2, 2),
    _c(_CL, "lda", "shrinkage", ["None", "auto", "manual"], "None"),
    _f(_CL, "lda", "shrinkage_factor", 0.0, 1.0, 0.5, False, "shrinkage", ["manual"]),
    _i(_CL, "lda", "n_components", 1, 250, 10),
    _f(_CL, "lda", "tol", 1e-5, 1e-1, 1e-4, True),
    _c(_CL, "liblinear_svc", "penalty", ["l1", "l2"], "l2"),
    _c(_CL, "liblinear_svc", "loss", ["hinge", "squared_hinge"], "squared_hinge"),
    _f(_CL, "liblinear_svc", "tol", 1e-5, 1e-1, 1e-4, True),
    _f(_CL, "liblinear_svc", "C", 0.03125, 32768, 1.0, True),
    _f(_CL, "libsvm_svc", "C", 0.03125, 32768, 1.0, True),
    _c(_CL, "libsvm_svc", "kernel", ["rbf", "poly", "sigmoid"], "rbf"),
    _i(_CL, "libsvm_svc", "degree", 1, 5, 3, False, "kernel", ["poly"]),
    _f(_CL, "libsvm_svc", "gamma", _GAMMA, 8, 0.1, True),
    _f(_CL, "libsvm_svc", "coef0", -1, 1, 0, False, "kernel", ["poly", "sigmoid"]),
    _c(_CL, "libsvm_svc", "shrinking", _BOOL, "True"),
    _f(_CL, "libsvm_svc", "tol", 1e-5, 1e-1, 1e-4, True),
    _f(_CL, "multinomial_nb", "alpha", 1e-2, 100, 1, True),
    _c(_CL, "multinomial_nb", "fit_prior", _BOOL, "True"),
    _c(_CL, "passive_aggresive", "loss", ["hinge", "squared_hinge"], "hinge"),
    _i(_CL, "passive_aggresive", "n_iter", 5, 1000, 20, True),
    _f(_CL, "passive_aggresive", "C", 1e-5, 10, 1, True),
    _f(_CL, "qda", "reg_param", 0.0, 10.0, 0.5),
    _c(_CL, "random_forest", "criterion", ["gini", "entropy"], "gini"),
    _f(_CL, "random_forest", "max_features", 0.5, 5, 1),
    _i(_CL, "random_forest", "min_samples_split", 2, 20, 2),
    _i(_CL, "random_forest", "min_samples_leaf", 1, 20, 1),
    _c(_CL, "random_forest", "bootstrap", _BOOL, "True"),
    _c(_CL, "sgd", "loss", ["hinge", "log", "modified_huber", "squared_hinge", "perceptron"], "log"),
    _c(_CL, "sgd", "penalty", ["l1", "l2", "elasticnet"], "l2"),
    _f(_CL, "sgd", "alpha", 10e-7, 1e-1, 0.0001, True),
    _f(_CL, "sgd", "l1_ratio", 1e-9, 1, 0.15, True, "penalty", ["elasticnet"]),
    _c(_CL, "sgd", "fit_intercept", ["True"], "True"),
    _i(_CL, "sgd", "n_iter", 5, 100, 20, True),
    _f(_CL, "sgd", "epsilon", 1e-5, 1e-1, 1e-4, True, "loss", ["modified_huber"]),
    _c(_CL, "sgd", "learning_rate", ["optimal", "invscaling", "constant"], "optimal"),
    _f(_CL, "sgd", "eta0", 1e-7, 0.1, 0.01),
    _f(_CL, "sgd", "power_t", 1e-5, 1, 0.25, False, "learning_rate", ["invscaling"]),
    _c(_CL, "sgd", "average", ["False", "True"], "False"),
]

# --- fixed values: (feature preprocessor, classifier) pairs that are never combined
SLOW_CLASSIFIERS = ["adaboost", "decision_tree", "extra_trees", "gradient_boosting", "k_nearest_neighbors", "libsvm_svc", "random_forest", "gaussian_nb"]
KERNEL_MAPS = ["kitchen_sinks", "nystroem_sampler"]
NEGATIVE_OUTPUT = ["kitchen_sinks", "pca", "fast_ica", "kernel_pca", "nystroem_sampler"]
FORBIDDEN_PAIRS = [(p, c) for c in SLOW_CLASSIFIERS for p in KERNEL_MAPS] + [(p, "multinomial_nb") for p in NEGATIVE_OUTPUT]

# --- fixed values: parameter values of one node that exclude each other
FORBIDDEN_VALUES = [
    {"feature_preprocessor:feature_agglomeration:affinity": ("manhattan", "cosine"), "feature_preprocessor:feature_agglomeration:linkage": ("ward",)},
    {"feature_preprocessor:linear_svm:penalty": ("l1",), "feature_preprocessor:linear_svm:loss": ("hinge",)},
    {"classifier:liblinear_svc:penalty": ("l1",)},
    {"classifier:liblinear_svc:penalty": ("l2",), "classifier:liblinear_svc:loss": ("hinge",)},
]


def nodes_of(step: str, preprocessors: list[str] | None = None, classifiers: list[str] | None = None) -> list[str]:
    """Node names of a step, in order; the last two steps can be restricted."""
    names = [n for s, n, _, _ in NODES if s == step]
    only = {"feature_preprocessor": preprocessors, "classifier": classifiers}.get(step)
    if only is None:
        return names
    unknown = set(only) - set(names)
    if unknown:
        raise ValueError(f"unknown {step} nodes: {sorted(unknown)}")
    return [n for n in names if n in only]


def parse_space(text: str) -> tuple[list[str], list[str]]:
    """``pre1,pre2-clf1,clf2`` to the two name lists."""
    pre, clf = text.split("-")
    split = lambda part: [n.strip() for n in part.split(",") if n.strip()]
    return split(pre), split(clf)


def steps_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, i, c) for i, (s, c) in enumerate(STEPS)], "step string, pos int, cached boolean")


def nodes_table(spark: SparkSession) -> DataFrame:
    rows = NODES
    return spark.createDataFrame(rows, "step string, node string, input array<string>, output array<string>")


def params_table(spark: SparkSession) -> DataFrame:
    rows = [
        (p.step, p.node, p.name, p.kind, None if p.low is None else float(p.low), None if p.high is None else float(p.high), p.log, list(p.choices), p.default, p.parent, list(p.parent_values))
        for p in PARAMS
    ]
    return spark.createDataFrame(
        rows,
        "step string, node string, param string, kind string, low double, high double, log boolean, choices array<string>, "
        "default string, parent string, parent_values array<string>",
    )


def forbidden_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORBIDDEN_PAIRS, "preprocessor string, classifier string")


def defaults_map(step: str, node: str) -> Column:
    """Default values of one node as a map column."""
    pairs = [F.lit(v) for p in PARAMS if (p.step, p.node) == (step, node) for v in (p.name, p.default)]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
