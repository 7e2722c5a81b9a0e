"""Upper tails of the chi-squared and F distributions as column functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) for an integer number of degrees of freedom (finite series)."""
    if not x > 0:
        return 1.0
    half = x / 2.0
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    total, term = 0.0, math.sqrt(half) / math.gamma(1.5)
    for i in range((df - 1) // 2):
        total += term
        term *= half / (i + 1.5)
    return math.erfc(math.sqrt(half)) + math.exp(-half) * total


def _stirling(x: float) -> float:
    """log Gamma(x) less (x - 1/2) log x - x + log(2 pi) / 2, for x >= 10."""
    y = 1.0 / (x * x)
    return (1.0 / 12.0 - y * (1.0 / 360.0 - y * (1.0 / 1260.0 - y / 1680.0))) / x


def _log_gamma_ratio(a: float, b: float) -> float:
    """log(Gamma(a + b) / (Gamma(a) Gamma(b))) without the cancellation of large logarithms."""
    small, large = min(a, b), max(a, b)
    if large < 10.0:
        return math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    growth = small * math.log(small + large) + (large - 0.5) * math.log1p(small / large) - small + _stirling(small + large) - _stirling(large)
    return growth - math.lgamma(small)


def beta_regularized(a: float, b: float, x: float) -> float:
    """I_x(a, b) by the continued fraction in its even/odd contraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_regularized(b, a, 1.0 - x)
    front = math.exp(_log_gamma_ratio(a, b) + a * math.log(x) + b * math.log1p(-x)) / a
    # evaluate 1/(1+ d1/(1+ d2/(1+ ...))) backwards from a depth that grows with sqrt(a, b)
    tail = 1.0
    for m in range(100 + int(10 * math.sqrt(max(a, b))), 0, -1):
        h = m // 2
        if m % 2:
            d = -(a + h) * (a + b + h) * x / ((a + 2 * h) * (a + 2 * h + 1))
        else:
            d = h * (b - h) * x / ((a + 2 * h - 1) * (a + 2 * h))
        tail = 1.0 + d / tail
    return front / tail


def f_tail(x: float, d1: float, d2: float) -> float:
    if not x > 0:
        return 1.0
    return beta_regularized(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * x))


def chi2_pvalue(score: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def run(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if v != v else chi2_tail(v, int(n)) for v, n in zip(s, k)], dtype="float64")

    return run(score, df)


def f_pvalue(score: Column, d1: Column, d2: Column) -> Column:
    @F.pandas_udf("double")
    def run(s: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if v != v else f_tail(v, p, q) for v, p, q in zip(s, a, b)], dtype="float64")

    return run(score, d1, d2)
