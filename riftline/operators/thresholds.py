"""Cutoffs, supra-threshold runs and the change points read from them.

Runs are islands of consecutive candidates (g above the cutoff, strictly). Of a
series' islands the last is dropped and those of one member are ignored; a
run's last member does not take part in reading its boundaries.

Islands are found inside chunks of time. Only those that touch a chunk's border,
two in a chunk at most, are then joined along the series, so one long series is
many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import CHUNK, gradient


def quantile_cutoffs(stat: DataFrame, levels: list[float]) -> DataFrame:
    """series_id, q, cutoff: linear quantiles over all places, the zero padding included. One pass for all levels."""
    at = F.array(*[F.lit(float(q)) for q in levels])
    wide = stat.groupBy("series_id").agg(F.percentile("g", at).alias("c"))
    return wide.select("series_id", F.posexplode("c").alias("k", "cutoff")).select("series_id", F.element_at(at, F.col("k") + 1).alias("q"), F.round("cutoff", 9).alias("cutoff"))


def large_quantile_cutoffs(stat: DataFrame, levels: list[float], bins: int = 4096) -> DataFrame:
    """As ``quantile_cutoffs``, for series whose distinct values don't fit a task.

    A histogram shows in which bins the order statistics lie that a level needs;
    only the values of these bins are counted one by one.
    """
    at = F.array(*[F.lit(float(q)) for q in levels])
    span = stat.groupBy("series_id").agg(F.min("g").alias("_lo"), F.max("g").alias("_hi"), F.count("g").alias("_n"))
    rows = stat.join(F.broadcast(span), "series_id")  # a row a series
    bin_ = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("g") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0).cast("long"))
    values = rows.groupBy("series_id", bin_.alias("_bin"), "g").agg(F.count("*").alias("_m"))
    up = lambda *keys: Window.partitionBy(*keys)
    counts = values.groupBy("series_id", "_bin").agg(F.sum("_m").alias("_size"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_size").over(up("series_id").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    want = span.select("series_id", F.posexplode(at).alias("_k", "q"), ((F.col("_n") - 1) * F.col("q")).alias("_at"))
    want = want.select("series_id", "q", "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank")).distinct()
    hit = want.join(counts, "series_id").where("_rank >= _before and _rank < _before + _size")
    inner = values.join(hit.select("series_id", "_bin", "_before").distinct(), ["series_id", "_bin"])
    inner = inner.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_m").over(up("series_id", "_bin").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found = hit.select("series_id", "q", "_at", "_rank", "_bin").join(inner.drop("_before"), ["series_id", "_bin"]).where("_rank >= _first and _rank < _first + _m")
    low, high = F.min_by("g", "_rank"), F.max_by("g", "_rank")
    value = low + (F.max("_at") - F.floor(F.max("_at"))) * (high - low)
    return found.groupBy("series_id", "q").agg(F.round(value, 9).alias("cutoff"))


RUN = ["series_id", "q"]
#: What a boundary rule reads of a run's body (its members but the last), as least values of structs.
READS = {
    "first_fall": ("grad", "t"),
    "first_rise": ("-grad", "t"),
    "peak": ("-g", "t"),
}


def pieces(stat: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Islands of candidates inside chunks: _c, _island, run, run_end, and for each read its value with and without the last member."""
    rows = gradient(stat).join(F.broadcast(cutoffs.select(*RUN, "cutoff")), "series_id").where("g > cutoff")  # a row a series and level
    rows = rows.withColumn("_c", F.floor(F.col("t") / CHUNK))
    here = Window.partitionBy(*RUN, "_c").orderBy("t")
    rows = rows.withColumn("_island", F.col("t") - F.row_number().over(here))
    rows = rows.withColumn("_ends", F.coalesce(F.lead("t").over(here) != F.col("t") + 1, F.lit(True)))
    out = [F.min("t").alias("run"), F.max("t").alias("run_end"), F.min("g").alias("low_all"), F.max("g").alias("high_all")]
    body = ~F.col("_ends")
    out += [F.min(F.when(body, F.col("g"))).alias("low_body"), F.max(F.when(body, F.col("g"))).alias("high_body")]
    for name, (value, at) in READS.items():
        pick = F.struct(F.expr(value).alias("v"), F.col(at).alias("t"))
        out += [F.min(pick).alias(f"{name}_all"), F.min(F.when(body, pick)).alias(f"{name}_body")]
    return rows.groupBy(*RUN, "_c", "_island").agg(*out)


def joined_runs(local: DataFrame) -> DataFrame:
    """Runs over all chunks: only islands that touch a border can go on, two in a chunk at most."""
    touches = (F.col("run") % CHUNK == 0) | (F.col("run_end") % CHUNK == CHUNK - 1)
    along = Window.partitionBy(*RUN).orderBy("run")
    border = local.where(touches).withColumn("_new", F.coalesce((F.col("run") != F.lag("run_end").over(along) + 1).cast("int"), F.lit(1)))
    border = border.withColumn("_g", F.sum("_new").over(along))
    last = F.col("run_end") == F.max("run_end").over(Window.partitionBy(*RUN, "_g"))
    least = {"low": F.min, "high": F.max, **dict.fromkeys(READS, F.min)}
    whole = border.withColumn("_last", last).groupBy(*RUN, "_g").agg(
        F.min("run").alias("run"),
        F.max("run_end").alias("run_end"),
        *[f(F.when(F.col("_last"), F.col(f"{name}_body")).otherwise(F.col(f"{name}_all"))).alias(name) for name, f in least.items()],
    )
    inner = local.where(~touches).select(*RUN, "run", "run_end", *[F.col(f"{name}_body").alias(name) for name in least])
    return inner.unionByName(whole.drop("_g"))


def runs_of(stat: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """series_id, q, run, run_end and the reads of every kept run."""
    runs = joined_runs(pieces(stat, cutoffs))
    last = F.max("run").over(Window.partitionBy(*RUN))  # one row a run
    return runs.withColumn("_last", last).where("run_end > run and run < _last").drop("_last")


def find_runs(stat: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """series_id, q, start, end of every kept run; ``end`` is its last member."""
    return runs_of(stat, cutoffs).select(*RUN, F.col("run").alias("start"), F.col("run_end").alias("end"))


def members_of(stat: DataFrame, runs: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The candidates of each kept run, by an as-of pass in chunks: a run is repeated in every chunk it lies in."""
    parts = runs.withColumn("_c", F.explode(F.sequence(F.floor(F.col("run") / CHUNK), F.floor(F.col("run_end") / CHUNK))))
    marks = parts.withColumn("t", F.greatest("run", F.col("_c") * CHUNK)).withColumn("_run", F.struct("run", "run_end", "low", "high"))
    rows = stat.select("series_id", "t", "g").join(F.broadcast(cutoffs.select(*RUN, "cutoff")), "series_id").where("g > cutoff")
    rows = rows.select(*RUN, F.floor(F.col("t") / CHUNK).alias("_c"), "t", "g", F.lit(None).cast(marks.schema["_run"].dataType).alias("_run"))
    both = rows.unionByName(marks.select(*RUN, "_c", "t", F.lit(None).cast("double").alias("g"), "_run"))
    order = Window.partitionBy(*RUN, "_c").orderBy("t", F.col("_run").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_r", F.last("_run", True).over(order)).where("g is not null and t <= _r.run_end")
    return found.select(*RUN, "t", "g", "_r.*")


def _edges(stat: DataFrame, cutoffs: DataFrame, rule: str) -> DataFrame:
    """series_id, q, edges: two boundaries of each run (one for ``peak``)."""
    if rule not in ("gradient", "run_edge", "half_max", "peak"):
        raise ValueError(f"unknown boundary rule {rule!r}")
    runs = runs_of(stat, cutoffs)
    if rule == "half_max":
        body = members_of(stat, runs, cutoffs).where("t < run_end and g >= (low + high) / 2")
        return body.groupBy(*RUN, "run").agg(F.array(F.min("t"), F.max("t")).alias("edges"))
    edges = {"gradient": ("first_fall.t", "first_rise.t"), "run_edge": ("run", "run_end"), "peak": ("peak.t",)}[rule]
    return runs.select(*RUN, "run", F.array(*edges).alias("edges"))


def change_points(stat: DataFrame, cutoffs: DataFrame, rule: str = "gradient") -> DataFrame:
    """series_id, q, t: distinct boundaries; all rules but ``peak`` add 0 and T - 1."""
    found = _edges(stat, cutoffs, rule).select("series_id", "q", F.explode("edges").alias("t"))
    if rule != "peak":
        ends = stat.groupBy("series_id").agg(F.max("n").alias("n")).join(cutoffs.select("series_id", "q"), "series_id")
        found = found.union(ends.select("series_id", "q", F.explode(F.array(F.lit(0).cast("long"), F.col("n") - 1)).alias("t")))
    return found.distinct()


def segments(points: DataFrame, stat: DataFrame | None = None, append_end: bool = False) -> DataFrame:
    """series_id, q, seg, start, end (excluded) between consecutive change points; ``append_end`` adds T as a point."""
    if append_end:
        n = stat.groupBy("series_id").agg(F.max("n").alias("t"))
        points = points.union(points.select("series_id", "q").distinct().join(n, "series_id").select("series_id", "q", "t"))
    order = Window.partitionBy("series_id", "q").orderBy("t")
    out = points.withColumn("end", F.lead("t").over(order)).withColumn("seg", F.row_number().over(order) - 1)
    return out.where("end is not null").select("series_id", "q", F.col("seg").cast("long").alias("seg"), F.col("t").alias("start"), "end")
