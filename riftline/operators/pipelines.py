"""Compositions: change points end to end, cutoffs by rule, clusterings of segments, grids of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from . import clustering as C
from . import nulls as N
from . import scoring as M
from . import segments as S
from . import thresholds as T
from . import windows as W

#: Replicates of the published nulls: of the permutation null, and of the automatic runs.
REPLICATES, AUTO_REPLICATES = 199, 30


def statistic_table(series: DataFrame, w: int, kind: str = "w2", periodic: bool = False) -> DataFrame:
    """A statistic written once, as cutoffs, runs and ends all read it."""
    stat = W.metric_derivative(series, w, periodic) if kind == "w2" else W.statistic(kind, series, w)
    return staged(stat, "statistic")


def find_change_points(series: DataFrame, w: int, level: float, periodic: bool = False, rule: str = "gradient") -> DataFrame:
    """series_id, q, t from the series alone."""
    stat = statistic_table(series, w, periodic=periodic)
    return T.change_points(stat, T.quantile_cutoffs(stat, [level]), rule)


def pilot_segments(stat: DataFrame, level: float) -> DataFrame:
    """Segments by a fixed quantile, up to the series' end."""
    return T.segments(T.change_points(stat, T.quantile_cutoffs(stat, [level])), stat, append_end=True)


CUTOFFS = ("fixed", "shuffle", "max", "block", "auto")


def cutoffs_by(rule: str, stat: DataFrame, w: int, level: float, null_level: float = 0.5, replicates: int = AUTO_REPLICATES, length: int = 10, scheme: str = "circular", seed: int = 0) -> DataFrame:
    """series_id, q, cutoff.

    ``fixed``: a quantile of the statistic. Others: a quantile of a null's
    statistics: ``shuffle`` pools the values of permutations, ``max`` takes their
    maxima, ``block`` pools block bootstraps of one length, ``auto`` of the length
    estimated for each series from its pilot segments.
    """
    if rule not in CUTOFFS:
        raise ValueError(f"unknown cutoff rule {rule!r}")
    if rule == "fixed":
        return T.quantile_cutoffs(stat, [level])
    series = stat.select("series_id", "t", "x", "n")
    if rule == "auto":
        length = N.auto_block_length(series, pilot_segments(stat, level), w).select("series_id", "block_length")
    of = N.null_max_cutoff if rule == "max" else N.null_cutoff
    out = of(series, w, null_level, "shuffle" if rule in ("shuffle", "max") else scheme, replicates, length, seed)
    return staged(out.select("series_id", "q", "cutoff"), "cutoffs")


def auto_change_points(series: DataFrame, w: int, level: float, null_level: float = 0.5, replicates: int = AUTO_REPLICATES) -> DataFrame:
    """series_id, q, t by the block null of estimated length, with the series' end as a point."""
    stat = statistic_table(series, w)
    points = T.change_points(stat, cutoffs_by("auto", stat, w, level, null_level, replicates))
    ends = stat.groupBy("series_id").agg(F.max("n").alias("t"))
    return points.union(points.select("series_id", "q").distinct().join(ends, "series_id").select("series_id", "q", "t"))


def by_rules(stat: DataFrame, w: int, level: float, rules=("fixed", "shuffle", "auto"), replicates: int = AUTO_REPLICATES) -> DataFrame:
    """rule, series_id, q, t: change points of one statistic by several cutoff rules."""
    parts = [T.change_points(stat, cutoffs_by(r, stat, w, level, replicates=replicates)).select(F.lit(r).alias("rule"), "series_id", "q", "t") for r in rules]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def oracle_points(series: DataFrame, ramps: DataFrame, q: float = 0.0) -> DataFrame:
    """Change points that are known: 0, both ends of every ramp, and the series' end."""
    ends = series.groupBy("series_id").agg(F.max("n").alias("n")).select("series_id", F.explode(F.array(F.lit(0).cast("long"), F.col("n"))).alias("t"))
    known = ramps.select("series_id", F.explode(F.array("start", "end")).alias("t"))
    return ends.union(known).distinct().select("series_id", F.lit(q).alias("q"), "t")


def cluster_changes(series: DataFrame, points: DataFrame, method: str = "adp", levels: int = 512, append_end: bool = True, **options) -> DataFrame:
    """series_id, q, seg, start, end, label, status of the segments between change points, by distances of quantile profiles."""
    segs = staged(T.segments(points, series, append_end), "segments")
    labels = C.profile_labels(S.samples(series, segs), method, levels=levels, **options)
    return segs.join(labels, ["series_id", "q", "seg"])


def labelled_points(series: DataFrame, clusters: DataFrame) -> DataFrame:
    """series_id, q, t, label of every point, each with its segment's label."""
    return S.point_labels(series, clusters.where("label is not null"), F.col("label"), "experiment")


THRESHOLDS = {"quantile": "fixed", "resample_pointwise": "shuffle"}


def cluster_trajectory(series: DataFrame, w: int, level: float, threshold: str = "quantile", replicates: int = REPLICATES, **options) -> DataFrame:
    """``cluster_changes`` with change points from a named choice of threshold."""
    if threshold not in THRESHOLDS:
        raise ValueError(f"unknown threshold {threshold!r}")
    stat = statistic_table(series, w)
    points = T.change_points(stat, cutoffs_by(THRESHOLDS[threshold], stat, w, level, replicates=replicates))
    return cluster_changes(stat.select("series_id", "t", "x", "n"), points, **options)


def detection_grid(series: DataFrame, truth: DataFrame, windows: list[int], levels: list[float], rules: list[str], taus: list[int], kinds=("w2",), cutoffs=("fixed",), replicates: int = AUTO_REPLICATES) -> DataFrame:
    """kind, w, cutoffs, rule, q, series_id, tau and scores of every setting against ``truth`` (series_id, truth).

    One statistic is written for each kind and window and shared by its cutoff
    rules, levels and boundary rules; windows that leave no place are left out by
    their series having no points but the trivial ones.
    """
    keys = ["kind", "w", "cutoffs", "rule", "series_id", "q"]
    parts = []
    for kind in kinds:
        for w in windows:
            stat = statistic_table(series, w, kind)
            sizes = stat.groupBy("series_id").agg(F.max("n").alias("n"))
            for cut in cutoffs:
                limits = T.quantile_cutoffs(stat, levels) if cut == "fixed" else cutoffs_by(cut, stat, w, levels[0], replicates=replicates)
                for rule in rules:
                    points = T.change_points(stat, limits, rule).join(sizes, "series_id").where("t > 0 and t < n - 1").drop("n")
                    parts.append(points.select(F.lit(kind).alias("kind"), F.lit(w).alias("w"), F.lit(cut).alias("cutoffs"), F.lit(rule).alias("rule"), "series_id", "q", "t"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = staged(found, "grid-points")
    settings = found.select(*keys).distinct()
    return M.tolerance_curve(found, settings.join(truth, "series_id").select(*keys, "truth"), taus, keys)
