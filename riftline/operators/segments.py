"""Segments of series: members, statistics, labels and optimal-transport distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..staging import staged

KEY = ["series_id", "q"]


def members(series: DataFrame, segs: DataFrame) -> DataFrame:
    """Points of every segment: the interval join of points and segments, by series.

    A segment's starts are few beside its points, so each point finds its segment
    by expanding the segments, whose lengths add up to the series.
    """
    points = segs.withColumn("t", F.explode(F.sequence("start", F.col("end") - 1)))
    return series.join(points, ["series_id", "t"])


def segment_stats(series: DataFrame, segs: DataFrame) -> DataFrame:
    rows = members(series, segs).groupBy(*KEY, "seg", "start", "end")
    return rows.agg((F.max("t") - F.min("t") + 1).alias("length"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def point_labels(series: DataFrame, segs: DataFrame, label: Column, mode: str = "experiment") -> DataFrame:
    """series_id, q, t, label of every point. ``library``: the last point of each segment and of the series stays 0."""
    if mode not in ("library", "experiment"):
        raise ValueError(f"unknown labelling {mode!r}")
    last = F.col("end") - (2 if mode == "library" else 1)
    spans = segs.withColumn("label", label).where(F.col("start") <= last)
    points = spans.select(*KEY, "label", F.explode(F.sequence("start", last)).alias("t"))
    every = series.select("series_id", "t").join(segs.select(*KEY).distinct(), "series_id")
    return every.join(points, [*KEY, "t"], "left").select(*KEY, "t", F.coalesce("label", F.lit(0)).alias("label"))


def samples(series: DataFrame, segs: DataFrame) -> DataFrame:
    """The sorted values of each segment."""
    return members(series, segs).groupBy(*KEY, "seg").agg(F.array_sort(F.collect_list("x")).alias("v"))


def pairs(rows: DataFrame) -> DataFrame:
    """Each unordered pair of a series' segments, i <= j, with both columns ``v``."""
    a = rows.select(*KEY, F.col("seg").alias("i"), F.col("v").alias("a"))
    b = rows.select(*KEY, F.col("seg").alias("j"), F.col("v").alias("b"))
    return a.join(b, KEY).where("i <= j")


def exact_w2(a: Column, b: Column) -> Column:
    """W2 of two sorted samples of any sizes: values at the midpoints between merged quantile steps, by integer arithmetic."""
    n, m = F.size(a).cast("long"), F.size(b).cast("long")
    steps = F.array_sort(F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: i * m), F.transform(F.sequence(F.lit(1).cast("long"), m), lambda j: j * n))))
    lower = F.slice(steps, F.lit(1), F.size(steps) - 1)
    cells = F.zip_with(lower, F.slice(steps, F.lit(2), F.size(steps) - 1), lambda s, e: F.struct(s.alias("s"), (e - s).alias("w")))
    gap = lambda c: F.get(a, F.floor(c["s"] / m).cast("int")) - F.get(b, F.floor(c["s"] / n).cast("int"))
    return F.sqrt(A.sum_of(F.transform(cells, lambda c: gap(c) * gap(c) * c["w"])) / (n * m))


def exact_distances(series: DataFrame, segs: DataFrame) -> DataFrame:
    return pairs(staged(samples(series, segs), "samples")).select(*KEY, "i", "j", exact_w2(F.col("a"), F.col("b")).alias("d"))


def sample_profile_distances(rows: DataFrame, levels: int = 512) -> DataFrame:
    """W2 of ``levels``-point quantile profiles of sorted samples ``v``, an approximation of the exact distance."""
    rows = staged(rows.withColumn("v", A.quantile_profile(F.col("v"), levels)), "profiles")  # both sides of the pairs read it
    d = F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(F.sqrt(A.squared_gap(F.col("a"), F.col("b")) / levels))
    return pairs(rows).select(*KEY, "i", "j", d.alias("d"))


def profiles(series: DataFrame, segs: DataFrame, levels: int = 512) -> DataFrame:
    """series_id, q, seg, v: the quantile profile of each segment."""
    return samples(series, segs).withColumn("v", A.quantile_profile(F.col("v"), levels))


def profile_distances(series: DataFrame, segs: DataFrame, levels: int = 512) -> DataFrame:
    return sample_profile_distances(samples(series, segs), levels)


def median_sigma(distances: DataFrame) -> DataFrame:
    """Half the median squared distance of distinct segments."""
    off = distances.where("i < j").groupBy(*KEY)
    return off.agg(F.greatest(F.median(F.col("d") * F.col("d")) / 2, F.lit(1e-12)).alias("sigma"))


def similarity(distances: DataFrame, sigma: Column) -> Column:
    return F.exp(-F.col("d") * F.col("d") / (2 * sigma))
