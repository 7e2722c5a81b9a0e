"""Linear and kernel classifiers, and the common shape of all classifiers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.arrow import map_matrix, to_lists, to_matrix
from foldwright.functions.exprs import argmax_index, doubles, softmax
from foldwright.operators import svm
from foldwright.operators.project import Nystroem
from foldwright.operators.select import width_of, with_vector
from foldwright.session import collect_bounded

MAX_CLASSES = 10_000


def class_values(df: DataFrame, label: str) -> list:
    """Sorted class list of the training rows."""
    rows = collect_bounded(df.select(label).distinct(), MAX_CLASSES, "classes")
    values = sorted(r[label] for r in rows)
    if not values:
        raise ValueError("no rows to fit on")
    return values


class Classifier:
    """``fit(df)`` returns a :class:`FittedClassifier`."""

    def __init__(self, label: str = "label", features: str = "features", row_id: str = "row_id"):
        self.label, self.features, self.row_id = label, features, row_id

    def fit(self, df: DataFrame) -> FittedClassifier:
        raise NotImplementedError


class FittedClassifier:
    """``predict`` adds a class column; ``scores`` an array with one number per class."""

    classes: list

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        lookup = F.array(*[F.lit(c) for c in self.classes])
        return self.scores(df, "_scores").withColumn(name, F.get(lookup, argmax_index("_scores"))).drop("_scores")

    def scores(self, df: DataFrame, name: str = "scores") -> DataFrame:
        raise NotImplementedError

    def probabilities(self, df: DataFrame, name: str = "probability") -> DataFrame:
        return self.scores(df, name).withColumn(name, softmax(name))


@dataclass
class ConstantModel(FittedClassifier):
    classes: list

    def scores(self, df: DataFrame, name: str = "scores") -> DataFrame:
        return df.withColumn(name, F.array(F.lit(0.0)))


@dataclass
class VectorModel(FittedClassifier):
    """Wraps a fitted Spark ML model; the classes were numbered 0..k-1 for it."""

    model: object
    classes: list
    features: str

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        lookup = F.array(*[F.lit(c) for c in self.classes])
        out = self.model.transform(with_vector(df, self.features))
        return out.select(*df.columns, F.get(lookup, F.col("_p").cast("int")).alias(name))

    def scores(self, df: DataFrame, name: str = "scores") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(with_vector(df, self.features))
        source = "probability" if "probability" in out.columns else "rawPrediction"
        return out.select(*df.columns, vector_to_array(source).alias(name))

    def probabilities(self, df: DataFrame, name: str = "probability") -> DataFrame:
        out = self.scores(df, name)
        return out if hasattr(self.model, "getProbabilityCol") and self.model.getProbabilityCol() else out.withColumn(name, softmax(name))


class VectorClassifier(Classifier):
    """Subclasses give a Spark ML classifier for the data at hand."""

    def estimator(self, df: DataFrame):
        raise NotImplementedError

    def spread(self, estimator, classes: int):
        """The estimator for so many classes."""
        return estimator

    def fit(self, df: DataFrame) -> FittedClassifier:
        classes = class_values(df, self.label)
        if len(classes) == 1:
            return ConstantModel(classes)
        lookup = F.array(*[F.lit(c) for c in classes])
        number = (F.array_position(lookup, F.col(self.label)) - 1).cast("double")
        train = with_vector(df, self.features).select("_vec", number.alias("_y"))
        est = self.spread(self.estimator(df), len(classes))
        est.setFeaturesCol("_vec").setLabelCol("_y").setPredictionCol("_p")
        return VectorModel(est.fit(train), classes, self.features)


class LinearSVM(Classifier):
    """Squared-hinge SVM per class against the others, with l2 or l1 penalty (:mod:`foldwright.operators.svm`)."""

    def __init__(self, C=1.0, tol=1e-4, penalty="l2", loss="squared_hinge", max_iter=100, weight=None, **kw):
        super().__init__(**kw)
        if penalty not in ("l1", "l2") or loss != "squared_hinge":
            raise ValueError("only the squared hinge with l2 or l1 penalty is allowed")
        self.C, self.tol, self.penalty, self.max_iter, self.weight = float(C), float(tol), penalty, int(max_iter), weight

    def weights(self, df: DataFrame, classes: list) -> np.ndarray:
        """(problems, columns + 1); two classes make one problem, the larger class being positive."""
        rows = svm.training_rows(df, classes, self.label, self.features, self.weight)
        return svm.solve(rows, self.problems(classes), width_of(df, self.features), self.C, self.penalty, self.tol, self.max_iter)

    @staticmethod
    def problems(classes: list) -> list[svm.Problem]:
        return [svm.Problem(1)] if len(classes) == 2 else [svm.Problem(i) for i in range(len(classes))]

    def fit(self, df: DataFrame) -> FittedClassifier:
        classes = class_values(df, self.label)
        if len(classes) == 1:
            return ConstantModel(classes)
        w = self.weights(df, classes)
        return LinearModel(np.concatenate([-w, w]) if len(classes) == 2 else w, classes, self.features)


@dataclass
class PairModel(FittedClassifier):
    """One weight row per pair of classes i < j over mapped features; a decision of zero or more is for i."""

    step: object
    weights: np.ndarray
    classes: list
    features: str

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return list(combinations(range(len(self.classes)), 2))

    def decisions(self, df: DataFrame, name: str = "decisions") -> DataFrame:
        """Adds the decisions of all pairs, in the order (0, 1), (0, 2), ..."""
        mapped = self.step.transform(df.withColumn("_kept", F.col(self.features)))
        out = mapped.withColumn(name, svm.decisions(self.weights, self.features))
        return out.drop(self.features).withColumnRenamed("_kept", self.features)

    def pair_rows(self, df: DataFrame, row_id: str = "row_id") -> DataFrame:
        """(row_id, i, j, decision): the input of :func:`pair_votes`, with classes in place of their numbers."""
        names = F.array(*[F.struct(F.lit(self.classes[i]).alias("i"), F.lit(self.classes[j]).alias("j")) for i, j in self.pairs])
        rows = self.decisions(df, "_d").select(row_id, F.explode(F.arrays_zip(names.alias("p"), F.col("_d").alias("decision"))).alias("e"))
        return rows.select(row_id, "e.p.i", "e.p.j", "e.decision")

    def scores(self, df: DataFrame, name: str = "scores") -> DataFrame:
        """Votes per class, plus its summed confidence squeezed into a third, which orders equal votes."""
        first, second = np.zeros((len(self.pairs), len(self.classes))), np.zeros((len(self.pairs), len(self.classes)))
        for k, (i, j) in enumerate(self.pairs):
            first[k, i], second[k, j] = 1.0, 1.0

        def vote(d: np.ndarray) -> np.ndarray:
            confidence = d @ (first - second)
            return (d >= 0) @ first + (d < 0) @ second + confidence / (3 * (np.abs(confidence) + 1))

        return self.decisions(df, "_d").withColumn(name, map_matrix(vote, "_d")).drop("_d")


class KernelSVM(Classifier):
    """Squared-hinge SVMs of all pairs of classes, trained in common passes over a landmark kernel map."""

    def __init__(self, C=1.0, kernel="rbf", degree=3, gamma=0.1, coef0=0.0, shrinking=True, tol=1e-4, landmarks=200, max_iter=50, weight=None, **kw):
        super().__init__(**kw)
        self.map = Nystroem(kernel, landmarks, gamma, degree, coef0, features=self.features, row_id=self.row_id)
        self.C, self.tol, self.max_iter, self.weight = float(C), float(tol), int(max_iter), weight

    def fit(self, df: DataFrame) -> FittedClassifier:
        classes = class_values(df, self.label)
        if len(classes) == 1:
            return ConstantModel(classes)
        step = self.map.fit(df)
        mapped = step.transform(df)
        pairs = [svm.Problem(i, j) for i, j in combinations(range(len(classes)), 2)]
        rows = svm.training_rows(mapped, classes, self.label, self.features, self.weight)
        w = svm.solve(rows, pairs, width_of(mapped.limit(1), self.features), self.C, "l2", self.tol, self.max_iter)
        return PairModel(step, w, classes, self.features)


def pair_votes(pairs: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row_id, class, score) from pairwise decisions (row_id, i, j, decision), i < j.

    A negative decision votes for j, any other for i.  The summed confidences are scaled into
    +-0.5 by their extremes over the whole table, so they only break ties between vote counts.
    """
    sides = pairs.select(
        row_id,
        F.explode(
            F.array(
                F.struct(F.col("i").alias("class"), (-F.col("decision")).alias("conf"), (F.col("decision") >= 0).cast("bigint").alias("vote")),
                F.struct(F.col("j").alias("class"), F.col("decision").alias("conf"), (F.col("decision") < 0).cast("bigint").alias("vote")),
            )
        ).alias("e"),
    )
    sums = sides.groupBy(row_id, F.col("e.class").alias("class")).agg(F.sum("e.conf").alias("conf"), F.sum("e.vote").alias("votes"))
    # with the votes beside them, the extremes read the shuffled sums of the result instead of shuffling their own;
    # the result names the sums in the same order, or Spark takes the two shuffles for different ones
    known = F.when(F.col("conf").isNotNull(), F.struct("conf", "votes"))
    low, high = F.min(known)["conf"], F.max(known)["conf"]
    reach = sums.agg(F.greatest(F.abs(high), F.abs(low))).scalar()
    spread = sums.agg(high - low).scalar()
    eps = float(np.finfo(np.float64).eps)
    scaled = F.when(spread == 0, F.lit(0.0)).otherwise(F.col("conf") * (F.lit(0.5 - eps) / reach))
    return sums.select(row_id, "class", (scaled + F.col("votes")).alias("score"))


# ---------------------------------------------------------------- averaged online learners

@dataclass
class LinearModel(FittedClassifier):
    """One weight row per class; the last column is the intercept."""

    weights: np.ndarray
    classes: list
    features: str
    link: str = "softmax"

    def scores(self, df: DataFrame, name: str = "scores") -> DataFrame:
        w, b = self.weights[:, :-1].T.copy(), self.weights[:, -1].copy()
        return df.withColumn(name, map_matrix(lambda x: x @ w + b, doubles(self.features)))

    def probabilities(self, df: DataFrame, name: str = "probability") -> DataFrame:
        out = self.scores(df, name)
        if self.link == "softmax":
            return out.withColumn(name, softmax(name))
        if self.link == "log":
            each = F.transform(name, lambda s: 1.0 / (1.0 + F.exp(-s)))
        else:  # modified huber
            each = F.transform(name, lambda s: (F.greatest(F.least(s, F.lit(1.0)), F.lit(-1.0)) + 1.0) / 2.0)
        out = out.withColumn(name, each)
        total = F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
        return out.withColumn(name, F.transform(name, lambda p: F.when(total == 0, 1.0 / len(self.classes)).otherwise(p / total)))


def averaged_epoch(train: DataFrame, weights: np.ndarray, local: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
    """One pass: every partition runs ``local`` from the same weights; the results are averaged.

    The average is weighted by the partition's rows and is formed by a shuffle per weight, so the
    driver receives one number per weight whatever the number of partitions.
    """

    def run(batches):
        w, seen = weights, 0
        for batch in batches:
            if batch.num_rows:
                x = to_matrix(batch.column(0))
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                w = local(w, x, y, seen)
                seen += len(y)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), to_lists(w.reshape(1, -1))], names=["n", "w"])

    parts = train.select("_x", "_y").mapInArrow(run, "n bigint, w array<double>")
    summed = parts.select("n", F.posexplode("w").alias("pos", "v")).groupBy("pos").agg(F.sum(F.col("v") * F.col("n")).alias("v"), F.sum("n").alias("n"))
    flat = np.zeros(weights.size)
    for r in collect_bounded(summed, weights.size, "averaged weights"):
        flat[r["pos"]] = r["v"] / r["n"]
    return flat.reshape(weights.shape)


def _with_intercept(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((x.shape[0], 1))])


def _targets(y: np.ndarray, k: int) -> np.ndarray:
    t = -np.ones((len(y), k))
    t[np.arange(len(y)), y] = 1.0
    return t


class _Averaged(Classifier):
    def _prepare(self, df: DataFrame) -> tuple[list, DataFrame, np.ndarray]:
        classes = class_values(df, self.label)
        lookup = F.array(*[F.lit(c) for c in classes])
        train = df.select(doubles(self.features).alias("_x"), (F.array_position(lookup, F.col(self.label)) - 1).cast("int").alias("_y")).persist()
        return classes, train, np.zeros((len(classes), width_of(train, "_x") + 1))


# slope of the loss at margin m = target * score
_SLOPES = {
    "hinge": lambda m: np.where(m < 1, -1.0, 0.0),
    "perceptron": lambda m: np.where(m <= 0, -1.0, 0.0),
    "squared_hinge": lambda m: np.where(m < 1, -2.0 * (1 - m), 0.0),
    "log": lambda m: -1.0 / (1.0 + np.exp(np.clip(m, -500, 500))),
    "modified_huber": lambda m: np.where(m >= 1, 0.0, np.where(m >= -1, -2.0 * (1 - m), -4.0)),
}


class SGD(_Averaged):
    """Stochastic gradient descent per class, in small batches, averaged over the partitions each epoch."""

    def __init__(self, loss="log", penalty="l2", alpha=1e-4, l1_ratio=0.15, n_iter=20, learning_rate="optimal", eta0=0.01,
                 power_t=0.25, average=False, epsilon=1e-4, batch=32, **kw):
        super().__init__(**kw)
        if loss not in _SLOPES:
            raise ValueError(f"unknown loss: {loss}")
        self.loss, self.alpha, self.n_iter, self.learning_rate = loss, float(alpha), int(n_iter), learning_rate
        self.eta0, self.power_t, self.average, self.batch = float(eta0), float(power_t), bool(average), int(batch)
        self.l1_share = {"l2": 0.0, "l1": 1.0, "elasticnet": float(l1_ratio if l1_ratio is not None else 0.15)}[penalty]

    def _rate(self, t: int) -> float:
        if self.learning_rate == "constant":
            return self.eta0
        if self.learning_rate == "invscaling":
            return self.eta0 / (t + 1) ** self.power_t
        typical = np.sqrt(1.0 / np.sqrt(self.alpha))
        first = typical / max(1.0, abs(float(_SLOPES[self.loss](np.array(-typical)))))
        return 1.0 / (self.alpha * (1.0 / (first * self.alpha) + t))

    def fit(self, df: DataFrame) -> LinearModel:
        classes, train, w = self._prepare(df)
        k, slope = len(classes), _SLOPES[self.loss]
        kept = []
        for epoch in range(self.n_iter):

            def local(start, x, y, seen, epoch=epoch):
                cur, z, t = start.copy(), _with_intercept(x), _targets(y, k)
                for lo in range(0, len(y), self.batch):
                    zb, tb = z[lo : lo + self.batch], t[lo : lo + self.batch]
                    step = self._rate((epoch * 1_000 + seen + lo))
                    grad = (slope(tb * (zb @ cur.T)) * tb).T @ zb / len(tb)
                    cur[:, :-1] *= max(0.0, 1.0 - step * self.alpha * (1 - self.l1_share))
                    cur -= step * grad
                    if self.l1_share:
                        cut = step * self.alpha * self.l1_share
                        cur[:, :-1] = np.sign(cur[:, :-1]) * np.maximum(np.abs(cur[:, :-1]) - cut, 0.0)
                return cur

            w = averaged_epoch(train, w, local)
            kept.append(w)
        train.unpersist()
        if self.average:
            w = np.mean(kept, axis=0)
        link = {"log": "log", "modified_huber": "huber"}.get(self.loss, "softmax")
        return LinearModel(w, classes, self.features, link)


class PassiveAggressive(_Averaged):
    """Passive-aggressive updates (PA-I for hinge, PA-II for squared hinge), averaged each epoch."""

    def __init__(self, C=1.0, loss="hinge", n_iter=20, **kw):
        super().__init__(**kw)
        if loss not in ("hinge", "squared_hinge"):
            raise ValueError(f"unknown loss: {loss}")
        self.C, self.loss, self.n_iter = float(C), loss, int(n_iter)

    def fit(self, df: DataFrame) -> LinearModel:
        classes, train, w = self._prepare(df)
        k = len(classes)

        def local(start, x, y, seen):
            cur, z, t = start.copy(), _with_intercept(x), _targets(y, k)
            norms = (z * z).sum(1)
            for r in range(len(y)):
                miss = np.maximum(0.0, 1.0 - t[r] * (cur @ z[r]))
                size = np.minimum(self.C, miss / norms[r]) if self.loss == "hinge" else miss / (norms[r] + 0.5 / self.C)
                cur += (size * t[r])[:, None] * z[r]
            return cur

        for _ in range(self.n_iter):
            w = averaged_epoch(train, w, local)
        train.unpersist()
        return LinearModel(w, classes, self.features)


# ---------------------------------------------------------------- multilabel wrapper

@dataclass
class MultilabelModel:
    """One fitted classifier per label column; predictions are an array of 0/1."""

    models: list
    label: str

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        out = df
        for i, m in enumerate(self.models):
            out = m.predict(out, f"_p{i}")
        cols = [f"_p{i}" for i in range(len(self.models))]
        return out.withColumn(name, F.array(*[F.col(c).cast("int") for c in cols])).drop(*cols)


class OneVsRestMultilabel:
    """Fit ``make(label_column)`` for every position of a 0/1 label array."""

    def __init__(self, make: Callable[[str], Classifier], label: str = "labels"):
        self.make, self.label = make, label

    def fit(self, df: DataFrame) -> MultilabelModel:
        width = width_of(df, self.label)
        models = []
        for i in range(width):
            models.append(self.make("_label").fit(df.withColumn("_label", F.col(self.label)[i].cast("int"))))
        return MultilabelModel(models, self.label)
