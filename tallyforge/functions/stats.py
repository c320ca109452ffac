"""Normal and Student-t tails for the one-row test results, and the series of the KS test."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, functions as F

NORMAL = NormalDist()


def z_critical(significance: float) -> float:
    return NORMAL.inv_cdf(1 - significance / 2)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_critical(significance: float, df: float) -> float:
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > significance else (low, mid)
    return (low + high) / 2


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided test of k successes in n trials at one half."""
    tail = sum(math.comb(n, i) for i in range(0, min(k, n - k) + 1)) / 2**n if n else 0.5
    return min(1.0, 2 * tail)


def mcnemar_p(b: float, c: float) -> float:
    """Exact for few discordant pairs, chi-square with continuity correction from 25 on."""
    if b + c < 25:
        return binomial_two_sided(int(b), int(b + c))
    chi = (abs(b - c) - 1) ** 2 / (b + c)
    return math.erfc(math.sqrt(chi / 2))


def ks_p(d: float, n: float, m: float) -> float:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    x = d * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def on_result(fn, *cols: Column) -> Column:
    """Apply a small function to the columns of a result row."""

    @F.pandas_udf("double")
    def udf(*series: pd.Series) -> pd.Series:
        return pd.Series([
            None if any(x is None or x != x for x in row) else fn(*row) for row in zip(*series)], dtype="float64")

    return udf(*cols)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
