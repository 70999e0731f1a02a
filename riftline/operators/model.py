"""The estimator: change points, segment clusters and point labels of series, by dimension."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from . import clustering as C
from . import distances as D
from . import scoring as M
from . import segments as S
from . import thresholds as T
from . import windows as W

#: Windows of a grid worked on together: each has plans of its own in the driver's memory.
AT_ONCE = 2


@dataclass(frozen=True)
class SegmentClusterer:
    """``fit`` takes series_id, dim, t, x, n; ``window`` and ``quantile`` may differ by dimension.

    Unless ``compat`` asks for sums of base-ten digits and ties by equal counts,
    labels of dimensions are combined without collisions and ranked by frequency,
    ties by their digits. All results are lazy.
    """

    window: int | dict = 100
    quantile: float | dict = 0.75
    periodic: bool = False
    method: str = "adp"
    clusters: int = 3
    compat: bool = False

    def _of(self, value, dim):
        return value[dim] if isinstance(value, dict) else value

    def _labels(self, series: DataFrame, dim, stat: DataFrame, levels: list[float]):
        """Change points, labelled segments and point labels of one dimension, for each level."""
        one = stat.select("series_id", "t", "x", "n")
        points = staged(T.change_points(stat, T.quantile_cutoffs(stat, levels)), "fit-points")
        segs = T.segments(points)
        samples = S.samples(one, segs)
        found = C.segment_labels(D.circle_distances(samples), self.method, self.clusters) if self.periodic else C.sample_labels(samples, self.method, self.clusters)
        labelled = staged(segs.join(found, ["series_id", "q", "seg"]), "fit-segments")
        labels = S.point_labels(one, labelled, F.col("label"), "library")
        return [df.withColumn("dim", F.lit(dim)) for df in (points, labelled, labels)]

    def _statistic(self, series: DataFrame, dim, w: int) -> DataFrame:
        one = series.where(F.col("dim") == dim).select("series_id", "t", "x", "n")
        return staged(W.metric_derivative(one, w, self.periodic), "fit-statistic")

    def fit(self, series: DataFrame, dims: list[int]) -> FittedSegments:
        """The statistic, change points and labelled segments are written as they are made; point labels are lazy."""
        parts = [self._labels(series, dim, self._statistic(series, dim, self._of(self.window, dim)), [self._of(self.quantile, dim)]) for dim in dims]
        return FittedSegments(self, *(union([p[k] for p in parts]) for k in range(3)))

    def fit_predict(self, series: DataFrame, dims: list[int]) -> DataFrame:
        return self.fit(series, dims).point_labels()

    def predict(self, series: DataFrame):
        raise NotImplementedError("labels belong to the series that was fitted")

    def grid_scores(self, series: DataFrame, dims: list[int], windows=None, quantiles=None, lag: int = 100) -> DataFrame:
        """window, quantile, score: VAMP-2 over the grid, averaged over series. One statistic and one plan for each window, for all quantiles."""
        if windows is None and quantiles is None and isinstance(self.window, dict):
            raise ValueError("nothing to search")

        def of_window(w):
            found = [self._labels(series, dim, self._statistic(series, dim, w), list(quantiles or (0.5, 0.6, 0.7, 0.8, 0.9)))[2] for dim in dims]
            labels = combined(union(found), ["series_id", "q"], self.compat)
            rows = scores(labels, ["series_id", "q"], lag).groupBy(F.col("q").alias("quantile")).agg(F.avg("vamp2").alias("score")).withColumn("window", F.lit(w))
            return staged(rows, "grid-scores")

        with ThreadPoolExecutor(AT_ONCE) as pool:  # the few tasks of one window leave cores to the next
            parts = list(pool.map(of_window, windows or list(range(32, 257, 32))))
        return union(parts).select("window", "quantile", "score")

    def grid_search(self, series: DataFrame, dims: list[int], windows=None, quantiles=None, lag: int = 100):
        """(best parameters, score): the first best score over the grid, by window and then quantile."""
        best = self.grid_scores(series, dims, windows, quantiles, lag).where("score is not null and not isnan(score)")
        best = best.orderBy(F.col("score").desc(), "window", "quantile").first()
        if best is None:
            raise RuntimeError("no parameters could be scored")
        return {"window": best.window, "quantile": best.quantile}, best.score


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@dataclass(frozen=True)
class FittedSegments:
    model: SegmentClusterer
    change_points: DataFrame
    segments: DataFrame
    labels_by_dim: DataFrame

    def point_labels(self) -> DataFrame:
        """series_id, t, label: combined labels by descending frequency, from 1."""
        return combined(self.labels_by_dim, ["series_id"], self.model.compat)

    def indicators(self) -> DataFrame:
        """series_id, dim, t, change: 1 at change points."""
        marks = self.change_points.select("series_id", "dim", "t", F.lit(1).alias("change"))
        return self.labels_by_dim.select("series_id", "dim", "t").join(marks, ["series_id", "dim", "t"], "left").withColumn("change", F.coalesce("change", F.lit(0)))

    def score(self, lag: int = 100) -> float | None:
        """VAMP-2 of the labels, averaged over series."""
        return scores(self.point_labels(), ["series_id"], lag).agg(F.avg("vamp2")).first()[0]


def combined(labels_by_dim: DataFrame, keys: list[str], compat: bool) -> DataFrame:
    """keys, t, label: the labels of all dimensions as one, by descending frequency, from 1."""
    by_point = labels_by_dim.groupBy(*keys, "t").agg(F.array_sort(F.collect_list(F.struct("dim", "label"))).alias("_d"))  # a label a dimension
    digits = F.transform("_d", lambda s: F.coalesce(s["label"], F.lit(0)))
    if compat:
        code = F.aggregate(F.transform(digits, lambda v, i: v * F.pow(F.lit(10), i).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v).cast("string")
    else:
        code = F.array_join(F.transform(digits, lambda v: v.cast("string")), "-")
    rows = by_point.select(*keys, "t", code.alias("_code"))
    counts = rows.groupBy(*keys, "_code").count()
    by = Window.partitionBy(*keys)
    rank = F.dense_rank().over(by.orderBy(F.col("count").desc())) if compat else F.row_number().over(by.orderBy(F.col("count").desc(), "_code"))
    return rows.join(counts.withColumn("label", rank), [*keys, "_code"]).select(*keys, "t", "label")


def scores(labels: DataFrame, keys: list[str], lag: int) -> DataFrame:
    """keys, vamp2; a single state scores 1, as its only singular value is kept."""
    counts = M.lag_counts(labels, "label", lag, keys)
    per = counts.groupBy(*keys).agg(F.count_distinct("from_state").alias("k")).join(M.vamp2(counts, keys), keys)
    return per.select(*keys, F.when(F.col("k") == 1, 1.0).otherwise(F.col("vamp2")).alias("vamp2"))


def top_labels(labels: DataFrame, count: int) -> DataFrame:
    """The ``count`` most frequent labels of each series."""
    sizes = labels.groupBy("series_id", "label").agg(F.count("*").alias("n"))
    by = Window.partitionBy("series_id").orderBy(F.col("n").desc(), "label")
    return sizes.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= count).drop("_r")
