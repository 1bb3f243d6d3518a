"""Tail probabilities that Spark lacks, as Arrow UDFs over whole columns."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from ..shipping import ship_package


def beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 / max(1e-300, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) > 0 else -1)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def t_tail(x: float, df: float) -> float:
    """P(T > x) of Student's t."""
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + x * x))
    return half if x > 0 else 1 - half


def gamma_tail(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for n in range(1, 1000):
        b += 2
        d, c = 1 / (-n * (n - a) * d + b), b - n * (n - a) / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def normal_tail(x: float) -> float:
    return 0.5 * erfc(x / sqrt(2))


@F.pandas_udf(DoubleType())
def _t_two_sided(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else 2 * t_tail(abs(a), b) for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def _normal_tail(x: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else normal_tail(a) for a in x], dtype="float64")


@F.pandas_udf(DoubleType())
def _chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else gamma_tail(b / 2, a / 2) for a, b in zip(x, df)], dtype="float64")


def t_two_sided(x: Column, df: Column) -> Column:
    ship_package(SparkSession.active())
    return _t_two_sided(x.cast("double"), df.cast("double"))


def normal_sf(x: Column) -> Column:
    ship_package(SparkSession.active())
    return _normal_tail(x.cast("double"))


def chi2_sf(x: Column, df: Column | int) -> Column:
    """With two degrees of freedom the tail is an exponential, which stays in the JVM."""
    if isinstance(df, int) and df == 2:
        return F.exp(-x / 2)
    ship_package(SparkSession.active())
    return _chi2_tail(x.cast("double"), F.lit(df).cast("double") if isinstance(df, int) else df.cast("double"))
