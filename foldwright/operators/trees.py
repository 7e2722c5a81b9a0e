"""Tree ensembles: decision tree, forests, gradient boosting, AdaBoost, random-trees embedding."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.functions.exprs import argmax_index
from foldwright.operators.linear import Classifier, FittedClassifier, VectorClassifier, class_values
from foldwright.operators.random_trees import RandomTrees, grow, matrix
from foldwright.operators.select import features_per_split, width_of, with_vector
from foldwright.operators.steps import FeatureStep, RowMap
from foldwright.session import materialize

MAX_DEPTH = 30  # deepest tree Spark builds


def _supported(depth: int) -> int:
    if depth > MAX_DEPTH:
        raise ValueError(f"trees deeper than {MAX_DEPTH} levels are not supported")
    return depth


def _instances(min_samples_leaf, min_samples_split) -> int:
    """Smallest node size; a node needs two children, so a split size is at most twice this."""
    return max(int(min_samples_leaf), math.ceil(int(min_samples_split) / 2))


class DecisionTree(VectorClassifier):
    """``max_depth`` is a factor of the number of columns, cut to an integer first (0, 1 or 2)."""

    def __init__(self, criterion="gini", max_depth=0.5, min_samples_split=2, min_samples_leaf=1, seed=1, **kw):
        super().__init__(**kw)
        self.criterion, self.max_depth, self.seed = criterion, float(max_depth), seed
        self.min_instances = _instances(min_samples_leaf, min_samples_split)

    def estimator(self, df):
        depth = max(1, int(self.max_depth) * width_of(df, self.features))
        return DecisionTreeClassifier(impurity=self.criterion, maxDepth=_supported(depth), minInstancesPerNode=self.min_instances, seed=self.seed)


class RandomForest(VectorClassifier):
    bootstrap_default = True

    def __init__(self, n_estimators=100, criterion="gini", max_features=1.0, min_samples_split=2, min_samples_leaf=1,
                 bootstrap=None, max_depth=15, seed=1, **kw):
        super().__init__(**kw)
        self.n_estimators, self.criterion, self.max_features = int(n_estimators), criterion, float(max_features)
        self.bootstrap = self.bootstrap_default if bootstrap is None else bool(bootstrap)
        self.min_instances, self.max_depth, self.seed = _instances(min_samples_leaf, min_samples_split), int(max_depth), seed

    def estimator(self, df):
        return RandomForestClassifier(
            numTrees=self.n_estimators, impurity=self.criterion, bootstrap=self.bootstrap, maxDepth=_supported(self.max_depth),
            minInstancesPerNode=self.min_instances, seed=self.seed,
            featureSubsetStrategy=str(features_per_split(self.max_features, width_of(df, self.features))),
        )


class ExtraTrees(RandomForest):
    """As the forest but without bootstrap; split points are Spark's candidate bins, not random ones."""

    bootstrap_default = False


class GradientBoosting(VectorClassifier):
    """Binary boosting per class (one against the rest); of two classes the second alone, as the first mirrors it."""

    def __init__(self, learning_rate=0.1, n_estimators=100, max_depth=3, min_samples_split=2, min_samples_leaf=1,
                 subsample=1.0, max_features=1.0, seed=1, **kw):
        super().__init__(**kw)
        self.learning_rate, self.n_estimators, self.max_depth = float(learning_rate), int(n_estimators), int(max_depth)
        self.subsample, self.max_features, self.seed = float(subsample), float(max_features), seed
        self.min_instances = _instances(min_samples_leaf, min_samples_split)

    def estimator(self, df):
        return GBTClassifier(
            stepSize=self.learning_rate, maxIter=self.n_estimators, maxDepth=self.max_depth, subsamplingRate=self.subsample,
            minInstancesPerNode=self.min_instances, seed=self.seed,
            featureSubsetStrategy=str(features_per_split(self.max_features, width_of(df, self.features))),
            cacheNodeIds=True, checkpointInterval=10,
        )

    def spread(self, estimator, classes):
        return estimator.setProbabilityCol("") if classes == 2 else OneVsRest(classifier=estimator, parallelism=4)


@dataclass
class BoostedModel(FittedClassifier):
    """Weighted votes of the rounds (SAMME) or summed log-probability contrasts (SAMME.R)."""

    rounds: list = field(default_factory=list)
    weights: list = field(default_factory=list)
    algorithm: str = "SAMME"
    features: str = "features"
    classes: list = field(default_factory=list)

    def scores(self, df: DataFrame, name: str = "scores") -> DataFrame:
        k = len(self.classes)
        out = with_vector(df, self.features).withColumn(name, F.array(*[F.lit(0.0)] * k))
        for model, weight in zip(self.rounds, self.weights):
            out = model.transform(out)
            vote = _contrast(vector_to_array("_prob"), k) if self.algorithm == "SAMME.R" else F.transform(
                F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.when(c == F.col("_pred").cast("int"), F.lit(float(weight))).otherwise(0.0)
            )
            out = out.withColumn(name, F.zip_with(name, vote, lambda a, b: a + b)).drop("_pred", "_prob", "_raw")
        return out.drop("_vec")

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        lookup = F.array(*[F.lit(c) for c in self.classes])
        return self.scores(df, "_scores").withColumn(name, F.get(lookup, argmax_index("_scores"))).drop("_scores")


def _contrast(prob, k: int):
    logs = F.transform(prob, lambda p: F.log(F.greatest(p, F.lit(1e-15))))
    mean = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / k
    return F.transform(logs, lambda x: (k - 1) * (x - mean))


def samme_round(df: DataFrame, label: str, decision: str, weight: str) -> DataFrame:
    """(total, error) of one boosting round: the weighted share of wrong decisions."""
    return df.agg(
        F.sum(weight).alias("total"),
        (F.sum(F.when(F.col(label) != F.col(decision), F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias("error"),
    )


def samme_alpha(error: float, k: int, learning_rate: float) -> float:
    return learning_rate * (math.log((1 - error) / max(error, 1e-300)) + math.log(k - 1))


class AdaBoost(Classifier):
    """Each round fits a weighted tree and re-weights the rows; the weights are checkpointed now and then."""

    def __init__(self, n_estimators=50, learning_rate=0.1, algorithm="SAMME.R", max_depth=1, seed=1, checkpoint_every=10, **kw):
        super().__init__(**kw)
        self.n_estimators, self.learning_rate, self.algorithm = int(n_estimators), float(learning_rate), algorithm
        self.max_depth, self.seed, self.checkpoint_every = int(max_depth), seed, checkpoint_every

    def fit(self, df: DataFrame) -> BoostedModel:
        classes = class_values(df, self.label)
        k = len(classes)
        lookup = F.array(*[F.lit(c) for c in classes])
        work = with_vector(df, self.features).select(
            "_vec", (F.array_position(lookup, F.col(self.label)) - 1).cast("int").alias("_y"), F.lit(1.0).alias("_w")
        )
        work = materialize(work)
        model = BoostedModel(algorithm=self.algorithm, features=self.features, classes=classes)
        total = float(work.count())
        for i in range(self.n_estimators):
            tree = DecisionTreeClassifier(
                featuresCol="_vec", labelCol="_y", weightCol="_w", maxDepth=self.max_depth, seed=self.seed + i,
                predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_raw",
            ).fit(work)
            decided = tree.transform(work)
            p = samme_round(decided, "_y", "_pred", "_w").first()
            if p["error"] <= 0:
                model.rounds.append(tree)
                model.weights.append(1.0)
                break
            if self.algorithm == "SAMME.R":
                prob = vector_to_array("_prob")
                own = F.log(F.greatest(F.get(prob, F.col("_y")), F.lit(1e-15)))
                others = F.aggregate(F.transform(prob, lambda q: F.log(F.greatest(q, F.lit(1e-15)))), F.lit(0.0), lambda a, x: a + x) - own
                factor = F.exp(-self.learning_rate * (k - 1) / k * (own - others / (k - 1)))
                weight = 1.0
            else:
                if p["error"] >= 1 - 1 / k:
                    break
                weight = samme_alpha(p["error"], k, self.learning_rate)
                factor = F.when(F.col("_y") != F.col("_pred"), math.exp(weight)).otherwise(1.0)
            model.rounds.append(tree)
            model.weights.append(weight)
            new = decided.withColumn("_w", F.col("_w") * factor)
            norm = new.agg(F.sum("_w").alias("s")).first()["s"]
            work = new.select("_vec", "_y", (F.col("_w") * (total / norm)).alias("_w"))
            if (i + 1) % self.checkpoint_every == 0:
                work = materialize(work)
        return model


class RandomTreesEmbedding(FeatureStep):
    """Leaf of every row in totally random trees; ``leaves`` holds ``tree * 2^(depth+1) + leaf``.

    ``max_depth`` bounds the number of leaves per tree, so the encoded width is known before the fit.
    """

    def __init__(self, n_estimators=10, max_depth=5, min_samples_split=2, min_samples_leaf=1, seed=1, **kw):
        super().__init__(**kw)
        self.n_estimators, self.max_depth, self.seed = int(n_estimators), int(max_depth), seed
        self.min_split, self.min_leaf = int(min_samples_split), int(min_samples_leaf)

    def _fit(self, dataset: DataFrame) -> RowMap:
        width = width_of(dataset, self.features)
        trees = grow(dataset, self.features, width, self.n_estimators, self.max_depth, self.min_split, self.min_leaf, self.seed)
        return _LeafMap(trees, width, self.features)


class _LeafMap(RowMap):
    """Rows without features keep null leaves and null features."""

    def __init__(self, trees: RandomTrees, columns: int, features: str):
        super().__init__(lambda a: a, features)
        self.trees, self.columns, self.width = trees, columns, trees.column.size

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, columns, width = self.trees, self.columns, self.width

        @F.arrow_udf("array<int>")
        def leaves(cells: pa.Array) -> pa.Array:
            known = cells.drop_null()
            found = trees.nodes(matrix(known, columns)) + np.arange(len(trees.column)) * trees.per_tree
            rows = iter(found.tolist())
            return pa.array([next(rows) if ok else None for ok in cells.is_valid().to_pylist()], pa.list_(pa.int32()))

        @F.arrow_udf("array<double>")
        def encoded(places: pa.Array) -> pa.Array:
            out = []
            for row in places.to_pylist():
                out.append(None if row is None else np.zeros(width))
                if row is not None:
                    out[-1][row] = 1.0
            return pa.array(out, pa.list_(pa.float64()))

        return dataset.withColumn("leaves", leaves(self.features)).withColumn(self.features, encoded("leaves"))
