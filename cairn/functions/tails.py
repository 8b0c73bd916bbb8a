"""Tail probabilities for rows of features: Spark SQL has no erf or gamma."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def chi2_1df(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else math.erfc(math.sqrt(max(v, 0.0) / 2)))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of all tables with the same margins that are no likelier."""
    rows, col, n = a + b, a + c, a + b + c + d

    def log_p(x: int) -> float:
        lg = math.lgamma
        return (lg(rows + 1) - lg(x + 1) - lg(rows - x + 1) + lg(n - rows + 1) - lg(col - x + 1) - lg(n - rows - col + x + 1)) - (lg(n + 1) - lg(col + 1) - lg(n - col + 1))

    here = log_p(a)
    every = (log_p(x) for x in range(max(0, rows + col - n), min(rows, col) + 1))
    return min(1.0, sum(math.exp(p) for p in every if p <= here + 1e-9))


@F.pandas_udf(T.DoubleType())
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*map(int, x)) for x in zip(a, b, c, d)])


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction, on
    whichever side of the mean it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 1_000_000):  # about the root of the larger of a and b
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def binomial_at_least(r: int, n: int, share: float) -> float:
    """P(X >= r) of n draws: exact for any n, in time that does not grow with it."""
    return 1.0 if r <= 0 else 0.0 if r > n else beta_share(share, r, n - r + 1)


def binomial_at_most(r: int, n: int, share: float) -> float:
    return 0.0 if r < 0 else 1.0 if r >= n else beta_share(1 - share, n - r, r + 1)


def _tail(of, share: float):
    @F.pandas_udf(T.DoubleType())
    def run(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([of(int(x), int(y), share) for x, y in zip(r, n, strict=True)], dtype="float64")

    return run


def upper_tail(share: float):
    """Of (r, n) columns: P(X >= r) for binomial X."""
    return _tail(binomial_at_least, share)


def lower_tail(share: float):
    return _tail(binomial_at_most, share)
