"""Column helpers on arrays of doubles, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_of(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def squared_gap(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays of one length."""
    return sum_of(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))


def quantile_at(ordered: Column, level: Column) -> Column:
    """Value of a sorted sample at ``level * n - 1/2``, linear between neighbours and clamped at the ends."""
    n = F.size(ordered)
    at = F.least(F.greatest(level * n - 0.5, F.lit(0.0)), (n - 1).cast("double"))
    low = F.floor(at).cast("int")
    high = F.least(low + 1, n - 1)
    return F.get(ordered, low) + (at - low) * (F.get(ordered, high) - F.get(ordered, low))


def quantile_profile(sample: Column, levels: int) -> Column:
    """``levels`` mid-point quantiles of an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: quantile_at(sample, (k + 0.5) / F.lit(float(levels))))
