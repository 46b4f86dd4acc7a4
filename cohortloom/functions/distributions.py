"""Tail probabilities and quantiles for small result tables.

Only pooled or summarised tables, tens of rows, pass through here.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or math.isnan(df):
        return math.nan
    if math.isinf(df):
        return math.erfc(abs(t) / math.sqrt(2.0))
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile (p > 0.5) by bisection on the two-sided tail."""
    if math.isnan(df):
        return math.nan
    tail, lo, hi = 2.0 * (1.0 - p), 0.0, 2.0
    while t_two_sided(hi, df) > tail and hi < 1e12:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if t_two_sided(mid, df) > tail:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - front * total
    b, c = x + 1.0 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2.0
        d = 1.0 / (num * d + b)
        c = b + num / c
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * h


def chi2_upper(x: float, df: float) -> float:
    return math.nan if math.isnan(x) or df <= 0 else gamma_upper(df / 2.0, x / 2.0)


def f_upper(x: float, df1: float, df2: float) -> float:
    if math.isnan(x) or df1 <= 0 or df2 <= 0:
        return math.nan
    return betainc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * x))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(T.DoubleType())
def t_two_sided_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_quantile_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(a, b) for a, b in zip(p, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def test_p_value_udf(test: pd.Series, x: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([
        math.nan if k is None else chi2_upper(v, a) if k == "chi2" else f_upper(v, a, b)
        for k, v, a, b in zip(test, x, df1, df2)], dtype="float64")
