"""Array expressions over one window, for plans that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def smoothed(v: Column) -> Column:
    """Mean of three neighbours, the ends repeated; shorter windows stay as they are."""
    at = lambda i: F.get(v, F.least(F.greatest(i, F.lit(0)), F.size(v) - 1))
    mean = F.transform(v, lambda x, i: (at(i - 1) + x + at(i + 1)) / 3)
    return F.when(F.size(v) < 3, v).otherwise(mean)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def slope(v: Column) -> Column:
    """Least-squares slope over positions 0, 1, ..."""
    n = F.size(v).cast("double")
    moment = F.aggregate(F.transform(v, lambda x, i: x * (i - (F.size(v) - 1) / 2)), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(moment, n * (n * n - 1) / 12)


def deviation(v: Column) -> Column:
    """Population standard deviation."""
    m = mean(v)
    return F.sqrt(total(F.transform(v, lambda x: (x - m) * (x - m))) / F.size(v))


def extent(v: Column) -> Column:
    return F.array_max(v) - F.array_min(v) + 1e-8


def entropy(probabilities: list[Column]) -> Column:
    """Entropy of class probabilities as a part of the largest possible one."""
    part = lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0))
    out = F.lit(0.0)
    for p in probabilities:
        out = out - part(p) * F.ln(part(p))
    return out / F.ln(F.lit(float(len(probabilities))))
