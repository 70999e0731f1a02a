"""Report algebra: bins, arg-extrema, rank correlation, interpolation, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(x: Column, edges: list[float], labels: list[str] | None = None, include_lowest: bool = False) -> Column:
    """Right-closed bins; null outside."""
    out = F.lit(None).cast("string")
    for k in range(len(edges) - 2, -1, -1):
        low = x >= edges[k] if include_lowest and k == 0 else x > edges[k]
        out = F.when(low & (x <= edges[k + 1]), labels[k] if labels else f"({edges[k]:g}, {edges[k + 1]:g}]").otherwise(out)
    return out


def arg_row(rows: DataFrame, keys: list[str], value: str, ties: list[str], largest: bool = False) -> DataFrame:
    """The row of each group with the least (or largest) value, the first by ``ties`` among equals. Reduced map-side."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct((-F.col(value) if largest else F.col(value)).alias("_v"), *ties)
    best = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, "_r.*")


def average_rank(rows: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """Ranks with ties averaged. Distinct values are counted first, so tied rows meet as one."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(out, F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2).drop("_n")
    return rows.join(ranks, [*keys, value])


def spearman(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    rows = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    ranked = average_rank(average_rank(rows, a, keys, "_ra"), b, keys, "_rb")
    rho = F.when((F.count_distinct(a) > 1) & (F.count_distinct(b) > 1), F.corr("_ra", "_rb"))
    return ranked.groupBy(*keys).agg(rho.alias("rho"), F.count("*").alias("n"))


def correlation_p(rho: float, n: int) -> float:
    """Two-sided p-value of a correlation by the t distribution: the incomplete beta function by continued fraction."""
    import math

    if n < 3 or abs(rho) >= 1:
        return 0.0 if n >= 3 else float("nan")
    dof = n - 2
    x = dof / (dof + rho * rho * dof / (1 - rho * rho))
    a, b = dof / 2, 0.5

    def fraction(a, b, x):
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def interpolate(points: DataFrame, at: DataFrame, x: str, y: str, keys: list[str], c: str) -> DataFrame:
    """Linear interpolation of y over x at each ``c``, clamped at the ends: an as-of join of both sides."""
    both = points.select(*keys, F.col(x).alias("_x"), F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("_p"), F.lit(None).cast("double").alias(c))
    both = both.union(at.select(*keys, F.col(c).alias("_x"), F.lit(None).cast(both.schema["_p"].dataType), F.col(c).cast("double")))
    order = Window.partitionBy(*keys).orderBy("_x", F.col("_p").isNull())
    low = F.last("_p", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("_p", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumn("_l", low).withColumn("_h", high).where(f"{c} is not null")
    line = F.col("_l.y") + (F.col(c) - F.col("_l.x")) * (F.col("_h.y") - F.col("_l.y")) / (F.col("_h.x") - F.col("_l.x"))
    value = F.when(F.col("_l").isNull(), F.col("_h.y")).when(F.col("_h").isNull() | (F.col("_l.x") == F.col(c)), F.col("_l.y")).otherwise(line)
    return rows.select(*keys, c, value.alias(y))


def histogram(rows: DataFrame, x: str, low: float, high: float, bins: int, keys: list[str]) -> DataFrame:
    """Counts of equal bins; the last one holds its right edge."""
    k = F.least(F.floor((F.col(x) - low) / ((high - low) / bins)), F.lit(bins - 1).cast("long"))
    return rows.where((F.col(x) >= low) & (F.col(x) <= high)).groupBy(*keys, k.alias("bin")).agg(F.count("*").alias("n"))


def strided(rows: DataFrame, order: list[str], keys: list[str], step: int, limit: int) -> DataFrame:
    """Every ``step``-th row of each group, ``limit`` at most: a sampling operator."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("_k", k).where(f"_k % {step} = 0 and _k < {step * limit}").drop("_k")


def stratified(rows: DataFrame, order: list[str], keys: list[str], count: int) -> DataFrame:
    """``count`` evenly spaced rows of each group, ends included; half positions round to even."""
    by = Window.partitionBy(*keys)
    ranked = rows.withColumn("_k", F.row_number().over(by.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(by))
    places = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(count - 1))).cast("int"))
    return ranked.where(F.array_contains(places, F.col("_k"))).drop("_k", "_n")
