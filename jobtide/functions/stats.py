"""Statistics Spark has no expression for."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return value


def beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Probability that |T| exceeds |t| under Student's t."""
    if math.isnan(t) or math.isnan(df):
        return math.nan
    if math.isinf(t):
        return 0.0
    return beta_ratio(df / 2.0, 0.5, df / (df + t * t))


def _t_pvalues(t: pd.Series, df: pd.Series) -> pd.Series:
    pairs = zip(t.astype(float), df.astype(float))
    return pd.Series(np.array([t_two_sided(a, b) for a, b in pairs], dtype=float))


def t_pvalue(t: Column | str, df: Column | str) -> Column:
    """Two-sided p of a t statistic; meant for an aggregated table."""
    return F.pandas_udf(_t_pvalues, "double")(t, df)


def welch(n1: Column, mean1: Column, var1: Column, n2: Column, mean2: Column, var2: Column) -> tuple[Column, Column]:
    """(t, degrees of freedom) of Welch's test from sizes, means and sample variances."""
    s1, s2 = var1 / n1, var2 / n2
    spread = F.when(s1 + s2 > 0, s1 + s2)
    df = spread * spread / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1))
    return (mean1 - mean2) / F.sqrt(spread), df
