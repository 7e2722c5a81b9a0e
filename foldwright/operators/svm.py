"""Linear support vector machines in the primal: squared hinge loss, l2 or l1 penalty, many problems in one pass.

A problem separates one class from another or from all others: minimise R(w) + C sum_i s_i max(0, 1 - y_i w.x_i)^2 over its rows, with
x ending in a one for the intercept (which the penalty includes) and R the halved squared l2 norm or the l1 norm.  The loss is convex
with a piecewise constant Hessian, so Newton steps end after a few passes.  A pass sums loss, gradient and Hessian of all problems in
the tasks, the sums are added by a shuffle, and the driver solves systems of the size of the columns; a second pass tries step lengths.
With very many columns the Hessian is not formed: l2 problems use conjugate gradients whose products are passes, l1 problems
accelerated proximal gradient steps.  All sums run over rows, so the answer does not depend on the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.functions.arrow import map_matrix, to_matrix
from foldwright.functions.exprs import doubles

HESSIAN_CELLS = 1 << 22  # of all problems of one pass: 32 MB
ADDERS = 32
STEPS = 0.5 ** np.arange(12)


@dataclass
class Problem:
    """Class number ``positive`` against class number ``negative``, or against all others."""

    positive: int
    negative: int | None = None


def summed(df: DataFrame, columns: list[str], block, size: int) -> np.ndarray:
    """The sum of ``block(batch)``, a vector of ``size`` numbers, over all batches of the columns.

    Every task emits one vector; ADDERS groups add them up, so the driver sees at most ADDERS vectors.
    """

    def run(batches):
        total = np.zeros(size)
        seen = False
        for batch in batches:
            if batch.num_rows:
                total += block(batch)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for part in table["part"]:
            total += np.frombuffer(part.as_py())
        return pa.table({"part": pa.array([total.tobytes()], pa.binary())})

    parts = df.select(*columns).mapInArrow(run, "part binary").withColumn("adder", F.spark_partition_id() % ADDERS)
    rows = parts.groupBy("adder").applyInArrow(lambda t: add(t), "part binary").collect()
    return np.sum([np.frombuffer(r["part"]) for r in rows], axis=0) if rows else np.zeros(size)


def _unpack(batch: pa.RecordBatch, problems: list[Problem]):
    """Rows with a one at the end, signs (rows, problems) with 0 for rows that take no part, and row weights."""
    x = to_matrix(batch.column(0))
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    y = batch.column(1).to_numpy(zero_copy_only=False)[:, None]
    positive = np.array([p.positive for p in problems])
    negative = np.array([-2 if p.negative is None else p.negative for p in problems])
    sign = np.where(y == positive, 1.0, np.where((negative == -2) | (y == negative), -1.0, 0.0))
    return x, sign, batch.column(2).to_numpy(zero_copy_only=False)[:, None] * (sign != 0)


def _loss_pass(df: DataFrame, problems: list[Problem], w: np.ndarray, hessian: bool):
    """(loss, gradient, Hessian) of sum s max(0, 1 - y w.x)^2 per problem."""
    k, d = w.shape
    size = k + k * d + (k * d * d if hessian else 0)

    def block(batch: pa.RecordBatch) -> np.ndarray:
        x, sign, weight = _unpack(batch, problems)
        slack = np.maximum(1.0 - sign * (x @ w.T), 0.0) * (weight > 0)
        out = [(weight * slack * slack).sum(axis=0), (-2.0 * (weight * sign * slack)).T @ x]
        if hessian:
            out += [2.0 * (x[a] * weight[a, p : p + 1]).T @ x[a] for p in range(k) for a in [np.flatnonzero(slack[:, p] > 0)]]
        return np.concatenate([o.ravel() for o in out])

    total = summed(df, ["x", "y", "s"], block, size)
    return total[:k], total[k : k + k * d].reshape(k, d), total[k + k * d :].reshape(k, d, d) if hessian else None


def _step_losses(df: DataFrame, problems: list[Problem], w: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Loss of every problem at w + t * step for the step lengths STEPS: (steps, problems)."""

    def block(batch: pa.RecordBatch) -> np.ndarray:
        x, sign, weight = _unpack(batch, problems)
        at, along = sign * (x @ w.T), sign * (x @ step.T)
        return np.concatenate([(weight * np.maximum(1.0 - at - t * along, 0.0) ** 2).sum(axis=0) for t in STEPS])

    return summed(df, ["x", "y", "s"], block, len(STEPS) * len(problems)).reshape(len(STEPS), -1)


def _product(df: DataFrame, problems: list[Problem], w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Hessian of the loss at w times v, per problem."""

    def block(batch: pa.RecordBatch) -> np.ndarray:
        x, sign, weight = _unpack(batch, problems)
        active = weight * (sign * (x @ w.T) < 1.0)
        return (2.0 * (active * (x @ v.T)).T @ x).ravel()

    return summed(df, ["x", "y", "s"], block, w.size).reshape(w.shape)


def _conjugate(df: DataFrame, problems: list[Problem], w: np.ndarray, gradient: np.ndarray, c: float, most: int = 60) -> np.ndarray:
    """Newton directions of the l2 problems: all run side by side, one pass a step."""
    x, r = np.zeros_like(w), -gradient
    p, rr = r.copy(), (r * r).sum(axis=1)
    goal = 1e-4 * np.maximum(rr, 1e-300)
    for _ in range(most):
        if (rr <= goal).all():
            break
        q = p + c * _product(df, problems, w, p)
        a = np.where(rr > goal, rr / np.maximum((p * q).sum(axis=1), 1e-300), 0.0)[:, None]
        x, r = x + a * p, r - a * q
        new = (r * r).sum(axis=1)
        p, rr = r + (new / np.maximum(rr, 1e-300))[:, None] * p, new
    return x


def _lasso_step(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, tol: float, sweeps: int = 200) -> np.ndarray:
    """Minimiser of gradient.d + d.H.d / 2 + |w + d|_1 by coordinate descent."""
    d, product = np.zeros_like(w), np.zeros_like(w)
    curve = np.maximum(np.diag(hessian), 1e-12)
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(w)):
            at = w[j] + d[j]
            z = at - (gradient[j] + product[j]) / curve[j]
            change = np.sign(z) * max(abs(z) - 1.0 / curve[j], 0.0) - at
            if change:
                d[j] += change
                product += change * hessian[:, j]
                most = max(most, abs(change))
        if most < 1e-3 * tol:
            break
    return d


def _objective(w: np.ndarray, loss: np.ndarray, c: float, penalty: str) -> np.ndarray:
    return (0.5 * (w * w).sum(axis=-1) if penalty == "l2" else np.abs(w).sum(axis=-1)) + c * loss


def _optimality(w: np.ndarray, gradient: np.ndarray, penalty: str) -> np.ndarray:
    """Largest entry of the smallest subgradient, per problem; ``gradient`` is that of the loss times C."""
    if penalty == "l2":
        return np.abs(w + gradient).max(axis=1)
    return np.where(w != 0, np.abs(gradient + np.sign(w)), np.maximum(np.abs(gradient) - 1.0, 0.0)).max(axis=1)


def solve(df: DataFrame, problems: list[Problem], width: int, c: float, penalty: str = "l2", tol: float = 1e-6, max_iter: int = 100) -> np.ndarray:
    """Weights (problems, width + 1) over the rows (x, y, s): features, class number, row weight.

    A problem ends when the largest entry of its smallest subgradient is below ``tol`` times that at w = 0.
    """
    d = width + 1
    if d * d > HESSIAN_CELLS // 4:
        return _solve_wide(df, problems, d, c, penalty, tol, max_iter)
    chunk = max(1, HESSIAN_CELLS // (d * d))
    return np.concatenate([_solve_newton(df, problems[i : i + chunk], d, c, penalty, tol, max_iter) for i in range(0, len(problems), chunk)])


def _solve_newton(df, problems, d, c, penalty, tol, max_iter) -> np.ndarray:
    w, first = np.zeros((len(problems), d)), None
    for _ in range(max_iter):
        loss, gradient, hessian = _loss_pass(df, problems, w, True)
        gap = _optimality(w, c * gradient, penalty)
        first = np.maximum(gap, 1e-300) if first is None else first
        live = gap > tol * first
        if not live.any():
            break
        step = np.zeros_like(w)
        for p in np.flatnonzero(live):
            if penalty == "l2":
                step[p] = -np.linalg.solve(c * hessian[p] + np.eye(d), w[p] + c * gradient[p])
            else:
                step[p] = _lasso_step(w[p], c * gradient[p], c * hessian[p] + 1e-10 * np.eye(d), tol)
        taken = _best_steps(df, problems, w, step, loss, c, penalty)
        if not taken.any():
            break
        w = w + taken[:, None] * step
    return w


def _best_steps(df, problems, w, step, loss, c, penalty) -> np.ndarray:
    """The step length with the least objective per problem; 0 when none is lower than now."""
    losses = _step_losses(df, problems, w, step)
    values = np.array([_objective(w + t * step, at, c, penalty) for t, at in zip(STEPS, losses, strict=True)])
    best = values.argmin(axis=0)
    return np.where(values.min(axis=0) < _objective(w, loss, c, penalty), STEPS[best], 0.0)


def _solve_wide(df, problems, d, c, penalty, tol, max_iter) -> np.ndarray:
    """Without a Hessian: Newton directions by conjugate gradients (l2), accelerated proximal gradient steps (l1)."""
    w, first = np.zeros((len(problems), d)), None
    if penalty == "l2":
        for _ in range(max_iter):
            loss, gradient, _ = _loss_pass(df, problems, w, False)
            gap = _optimality(w, c * gradient, "l2")
            first = np.maximum(gap, 1e-300) if first is None else first
            if not (gap > tol * first).any():
                break
            step = _conjugate(df, problems, w, w + c * gradient, c)
            taken = _best_steps(df, problems, w, step, loss, c, "l2")
            if not taken.any():
                break
            w = w + taken[:, None] * step
        return w
    # the largest curvature of 2 C sum s x x' bounds that of every problem
    v = np.ones((1, d)) / np.sqrt(d)
    every = [Problem(-3)]
    for _ in range(12):
        u = _product(df, every, np.zeros((1, d)), v)
        size = float(np.linalg.norm(u))
        v = u / max(size, 1e-300)
    rate = 1.0 / max(1.2 * c * size, 1e-300)
    ahead, momentum = w, 1.0
    for _ in range(20 * max_iter):
        _, gradient, _ = _loss_pass(df, problems, ahead, False)
        gap = _optimality(ahead, c * gradient, "l1")
        first = np.maximum(gap, 1e-300) if first is None else first
        if not (gap > tol * first).any():
            return ahead
        z = ahead - rate * c * gradient
        new = np.sign(z) * np.maximum(np.abs(z) - rate, 0.0)
        if ((ahead - new) * (new - w)).sum() > 0:  # the momentum points uphill
            momentum = 1.0
        then = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, w, momentum = new + (momentum - 1) / then * (new - w), new, then
    return w


def training_rows(df: DataFrame, classes: list, label: str, features: str, weight: str | None = None) -> DataFrame:
    """(x, y, s) with class numbers by position in ``classes``."""
    lookup = F.array(*[F.lit(v) for v in classes])
    s = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.select(doubles(features).alias("x"), (F.array_position(lookup, F.col(label)) - 1).cast("int").alias("y"), s.alias("s"))


def loss_and_gradient(df: DataFrame, problems: list[Problem], w: np.ndarray, c: float, penalty: str = "l2") -> tuple[np.ndarray, np.ndarray]:
    """Objective and largest entry of the smallest subgradient of every problem at the given weights."""
    loss, gradient, _ = _loss_pass(df, problems, w, False)
    return _objective(w, loss, c, penalty), _optimality(w, c * gradient, penalty)


def decisions(w: np.ndarray, features: str):
    """Array column of w.x + b of every problem."""
    return map_matrix(lambda x: x @ w[:, :-1].T + w[:, -1], doubles(features))
