"""Squared-hinge machines against plain numpy solvers, for every partitioning and both ways of solving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.operators import svm
from foldwright.operators.linear import KernelSVM, LinearSVM, pair_votes
from foldwright.operators.select import LinearSelect
from foldwright.operators.steps import Identity


def data(n=240, d=6, classes=3, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = np.argmax(x[:, :classes] + 0.8 * rng.normal(size=(n, classes)), axis=1)
    return x, y


def frame(spark, x, y, partitions=4, weight=None):
    rows = [(i, int(c), [float(v) for v in r], 1.0 if weight is None else float(weight[i])) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "row_id long, label int, features array<double>, weight double").repartition(partitions)


def plain(x, sign, s, c, penalty, steps=200_000):
    """Proximal gradient descent with momentum, to convergence."""
    a = np.c_[x, np.ones(len(x))]
    rate = 1 / (2 * c * np.linalg.norm(a * np.sqrt(s)[:, None], 2) ** 2 + 1)
    w, v, m = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0
    for _ in range(steps):
        g = -2 * c * (s * sign * np.maximum(1 - sign * (a @ v), 0)) @ a + (v if penalty == "l2" else 0)
        z = v - rate * g
        new = z if penalty == "l2" else np.sign(z) * np.maximum(np.abs(z) - rate, 0)
        if (v - new) @ (new - w) > 0:
            m = 1.0
        t = (1 + np.sqrt(1 + 4 * m * m)) / 2
        v = new + (m - 1) / t * (new - w)
        if np.abs(new - w).max() < 1e-11 and np.abs(v - new).max() < 1e-11:
            break
        w, m = new, t
    return new


@pytest.mark.parametrize("penalty", ["l2", "l1"])
@pytest.mark.parametrize("wide", [False, True])
def test_weights(spark, monkeypatch, penalty, wide):
    if wide:
        monkeypatch.setattr(svm, "HESSIAN_CELLS", 4)
    x, y = data()
    c = 0.2
    got = [svm.solve(svm.training_rows(frame(spark, x, y, p), [0, 1, 2], "label", "features"), [svm.Problem(k) for k in range(3)], 6, c, penalty, 1e-7) for p in ((4,) if wide else (2, 8))]
    for k in range(3):
        want = plain(x, np.where(y == k, 1.0, -1.0), np.ones(len(x)), c, penalty)
        for w in got:
            np.testing.assert_allclose(w[k], want, atol=2e-5)
    np.testing.assert_allclose(got[0], got[-1], atol=1e-9)


def test_pairs_use_their_rows_only(spark):
    x, y = data(classes=4)
    weight = np.where(y == 1, 2.0, 0.5)
    rows = svm.training_rows(frame(spark, x, y, 3, weight), [0, 1, 2, 3], "label", "features", "weight")
    pairs = [svm.Problem(0, 1), svm.Problem(1, 3)]
    w = svm.solve(rows, pairs, 6, 0.3, tol=1e-8)
    for row, (i, j) in zip(w, [(0, 1), (1, 3)], strict=True):
        at = np.isin(y, [i, j])
        np.testing.assert_allclose(row, plain(x[at], np.where(y[at] == i, 1.0, -1.0), weight[at], 0.3, "l2"), atol=2e-5)
    loss, gap = svm.loss_and_gradient(rows, pairs, w, 0.3)
    assert (gap < 1e-4).all() and (loss > 0).all()


def test_chunks_of_problems(spark, monkeypatch):
    x, y = data()
    rows = svm.training_rows(frame(spark, x, y), [0, 1, 2], "label", "features")
    problems = [svm.Problem(k) for k in range(3)]
    every = svm.solve(rows, problems, 6, 0.5)
    monkeypatch.setattr(svm, "HESSIAN_CELLS", 4 * 49)
    np.testing.assert_allclose(every, svm.solve(rows, problems, 6, 0.5), atol=1e-9)


def test_selection_drops_noise(spark):
    x, y = data(n=400, d=8, classes=2, seed=5)
    kept = LinearSelect(C=0.02).fit(frame(spark, x, y)).info["positions"]
    assert kept == [0, 1]


def test_kernel_machine_votes(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(-2, 2, size=(400, 2))
    y = (np.hypot(x[:, 0], x[:, 1]) // 0.8).clip(0, 2).astype(int)  # rings
    df = frame(spark, x, y)
    model = KernelSVM(C=5.0, gamma=1.0, landmarks=60).fit(df)
    assert len(model.weights) == 3
    found = {r["row_id"]: r["prediction"] for r in model.predict(df).collect()}
    assert np.mean([found[i] == c for i, c in enumerate(y)]) > 0.93
    pairs = model.pair_rows(df)
    best: dict[int, tuple] = {}
    for r in pair_votes(pairs).collect():
        best.setdefault(r["row_id"], []).append((round(r["score"]), r["class"]))
    for i, scores in best.items():
        top = max(s for s, _ in scores)
        if sum(s == top for s, _ in scores) == 1:
            assert found[i] == next(c for s, c in scores if s == top)
    assert pairs.count() == 3 * 400


def test_two_classes_and_one(spark):
    x, y = data(classes=2)
    model = LinearSVM(C=1.0).fit(frame(spark, x, y))
    got = model.predict(frame(spark, x, y)).select((F.col("prediction") == F.col("label")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got > 0.75 and model.weights.shape == (2, 7)
    assert LinearSVM().fit(frame(spark, x, np.zeros(len(x)))).classes == [0]
    with pytest.raises(ValueError):
        LinearSVM(loss="hinge")
    assert Identity().fit(frame(spark, x, y)) is not None
