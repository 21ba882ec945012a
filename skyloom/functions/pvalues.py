"""Tail probabilities as column expressions (finite sums) and, where none is closed, Arrow-batched functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _log(x: Column) -> Column:
    return F.coalesce(F.log(x), F.lit(-math.inf))


def poisson_sf(observed: Column, expected: Column) -> Column:
    """P(X >= observed): one less the sum of the terms below, each made from the one before in logarithms, as large counts underflow."""
    n = F.greatest(F.floor(observed).cast("int"), F.lit(0))
    start = F.struct((-expected).cast("double").alias("term"), F.lit(0.0).alias("total"))
    step = lambda s, k: F.struct((s["term"] + _log(expected / k)).alias("term"), (s["total"] + F.exp(s["term"])).alias("total"))
    below = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>")), start, step, lambda s: s["total"])
    return F.greatest(1 - below, F.lit(0.0))


def binomial_sf(successes: Column, trials: Column, rate: float) -> Column:
    """P(X >= successes)."""
    n = F.greatest(successes.cast("int"), F.lit(0))
    start = F.struct((trials * F.lit(math.log1p(-rate))).alias("term"), F.lit(0.0).alias("total"))
    step = lambda s, k: F.struct((s["term"] + _log((trials - k + 1) / k * (rate / (1 - rate)))).alias("term"), (s["total"] + F.exp(s["term"])).alias("total"))
    below = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>")), start, step, lambda s: s["total"])
    return F.greatest(1 - below, F.lit(0.0))


def chi2_sf_even(x: Column, half_dof: Column) -> Column:
    """The chi-squared tail for 2 * half_dof degrees of freedom: a finite sum, its terms in logarithms."""
    start = F.struct((-x / 2).cast("double").alias("term"), F.lit(0.0).alias("total"))
    step = lambda s, k: F.struct((s["term"] + _log(x / 2 / k)).alias("term"), (s["total"] + F.exp(s["term"])).alias("total"))
    return F.aggregate(F.sequence(F.lit(1), half_dof.cast("int")), start, step, lambda s: s["total"])


@F.pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    """P(Z > max(z, 0)); null stays null."""
    return z.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(max(v, 0.0) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def normal_sf_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


def _upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    """The chi-squared tail for any degrees of freedom."""
    return pd.Series([None if a != a or b != b else _upper_gamma(b / 2, a / 2) for a, b in zip(x, dof, strict=True)], dtype="float64")


def _isf(p: float) -> float:
    """The z with P(Z > z) = p, by bisection of erfc."""
    low, high = -40.0, 40.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if 0.5 * math.erfc(middle / math.sqrt(2)) > p else (low, middle)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def normal_isf(p: pd.Series) -> pd.Series:
    return p.map(lambda v: None if v is None or v != v else _isf(min(v, 0.5)))


@F.pandas_udf(DoubleType())
def kolmogorov_sf(d: pd.Series, n: pd.Series) -> pd.Series:
    """The asymptotic tail of the Kolmogorov statistic."""

    def one(x: float, m: float) -> float:
        t = x * (math.sqrt(m) + 0.12 + 0.11 / math.sqrt(m))
        return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)))) if t > 0.2 else 1.0

    return pd.Series([one(a, b) for a, b in zip(d, n, strict=True)], dtype="float64")
