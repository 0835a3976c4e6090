"""Statistics Spark has no built-in for, as expressions over mergeable aggregates."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ship the worker functions by value: executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def skew_g1(n: Column, population_skew: Column) -> Column:
    """Bias-corrected skewness; 0 for a constant column, null below three values."""
    n = n.cast("double")
    g1 = F.coalesce(population_skew, F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, g1)


def kurt_g2(n: Column, population_kurt: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant column, null below four values."""
    n = n.cast("double")
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population_kurt + 6)
    return F.when(n >= 4, F.coalesce(g2, F.lit(0.0)))


def ks_pvalue(d: Column, n_a: Column, n_b: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample Kolmogorov-Smirnov statistic.

    Two rapidly converging series: one for large and one for small arguments.
    """
    lam = d * F.sqrt(n_a.cast("double") * n_b / (n_a + n_b))
    tail = sum(((-1) ** (k - 1)) * 2.0 * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 6))
    head = 1.0 - F.lit(math.sqrt(2 * math.pi)) / lam * sum(
        F.exp(-((2 * k - 1) ** 2) * math.pi ** 2 / (8.0 * lam * lam)) for k in range(1, 5))
    p = F.when(lam < 0.2, F.lit(1.0)).when(lam < 1.1, head).otherwise(tail)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def _chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution (regularised incomplete gamma)."""
    if not df > 0 or x != x:
        return math.nan
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    a, z = df / 2.0, x / 2.0
    if a > 50_000:  # normal limit of the cube root; error far below 1e-6 here
        t = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
        return 0.5 * math.erfc(t / math.sqrt(2))
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:  # power series of the lower tail
        term = total = 1.0 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= z / k
            total += term
        return min(1.0, max(0.0, 1.0 - front * total))
    b = z + 1 - a  # continued fraction of the upper tail
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 100_000):
        step = i * (a - i)
        b += 2
        d = 1.0 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return min(1.0, max(0.0, front * h))


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(statistic: pd.Series, df: pd.Series) -> pd.Series:
    """p-value of a chi-square statistic; applied to one row per table column only."""
    return pd.Series([_chi2_sf(float(x), float(k)) for x, k in zip(statistic, df)])
