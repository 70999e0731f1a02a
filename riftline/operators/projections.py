"""Row-wise projections and filters of series, labels and ramps, and joins of points with ramps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_slice(series: DataFrame, low: int, high: int) -> DataFrame:
    """Places ``low`` to ``high`` (excluded), numbered anew from 0; a negative ``high`` counts from the end."""
    end = F.lit(high) if high >= 0 else F.col("n") + high
    size = F.greatest(F.least(end, F.col("n")) - low, F.lit(0))
    return series.where((F.col("t") >= low) & (F.col("t") < end)).withColumn("t", F.col("t") - low).withColumn("n", size)


def rescale(x: Column, low: float, high: float) -> Column:
    """[low, high) to [0, 1), degrees to turns for instance."""
    return (x - low) / (high - low)


def unscale(u: Column, low: float, high: float) -> Column:
    return u * (high - low) + low


def inner_points(points: DataFrame, sizes: DataFrame, keep_last: bool = False) -> DataFrame:
    """Change points without the trivial ones 0 and n - 1 (``keep_last``: without 0 alone). ``sizes``: series_id, n."""
    last = F.col("n") if keep_last else F.col("n") - 1
    return points.join(sizes, "series_id").where((F.col("t") > 0) & (F.col("t") < last)).drop("n")


def close_to(x: Column, value: float, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    return F.abs(x - value) <= absolute + relative * abs(value)


def without_transitions(rows: DataFrame, label: str, transition=1) -> DataFrame:
    """The two-state target: rows of the transition state left out, nulls kept out too."""
    return rows.where(F.col(label) != F.lit(transition))


def window_of(setting: Column, length: Column) -> Column:
    """Samples of a window setting: ``oracle`` is twice the transition length, 2 at least; ``wN`` is N; others fail."""
    number = F.regexp_extract(setting, r"^w(\d+)$", 1)
    return F.when(setting == "oracle", F.greatest(2 * length, F.lit(2)).cast("int")).when(number != "", number.try_cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("unknown window setting "), F.coalesce(setting, F.lit("null")))).cast("int")
    )


def expected_length(length: Column, samples: int = 5000, ramps: int = 19) -> Column:
    """Samples of a trajectory: those of its states and those of its ramps."""
    return samples + ramps * length


def expected_quantile(length: Column, samples: int = 5000, ramps: int = 19) -> Column:
    """The share of a trajectory outside its ramps."""
    return 1 - ramps * length / expected_length(length, float(samples), ramps)


def core_state(x: Column, core: float) -> Column:
    """A below -core, B above core, strictly; else transition."""
    return F.when(x < -core, "A").when(x > core, "B").otherwise("transition")


def _beginnings(ramps: DataFrame, strict: bool, chunk: int) -> DataFrame:
    """series_id, _c, _at, _r: each ramp's beginning, and its mark at the start of every chunk up to the next ramp's."""
    number = Window.partitionBy("series_id").orderBy("start")  # one row a ramp
    marks = ramps.select("series_id", "ramp", "start", "end").withColumn("_passed", F.row_number().over(number) - 1)
    marks = marks.withColumn("_next", F.lead("start").over(number))
    begin = F.col("start") + (1 if strict else 0)
    last = F.floor(F.coalesce(F.col("_next"), F.col("end") + chunk) / chunk)
    info = F.struct("ramp", F.col("start").alias("since"), F.col("end").alias("until"), F.col("_passed").alias("before"))
    marks = marks.select("series_id", F.explode(F.sequence(F.floor(begin / chunk), F.greatest(last, F.floor(begin / chunk)))).alias("_c"), begin.alias("_b"), info.alias("_r"))
    return marks.withColumn("_at", F.greatest("_b", F.col("_c") * chunk))


def with_latest_ramp(points: DataFrame, ramps: DataFrame, strict: bool = False, chunk: int = 1 << 14) -> DataFrame:
    """``points`` (series_id, t ...) with ``ramp``, ``since``, ``until``, ``before`` of the last ramp that began at or before (strictly before) ``t``.

    An as-of join: points and the ramps' beginnings in one order, a chunk of time
    at a time; a ramp is repeated in the chunks up to the next ramp's beginning.
    Points after the last such chunk meet the series' last ramp by its id.
    """
    marks = _beginnings(ramps, strict, chunk)
    names = [c for c in points.columns if c != "series_id"]
    rows = points.select("series_id", F.floor(F.col("t") / chunk).alias("_c"), F.col("t").alias("_at"), F.struct(*names).alias("_p"), F.lit(None).cast(marks.schema["_r"].dataType).alias("_r"))
    both = rows.unionByName(marks.select("series_id", "_c", "_at", F.lit(None).cast(rows.schema["_p"].dataType).alias("_p"), "_r"))
    order = Window.partitionBy("series_id", "_c").orderBy("_at", F.col("_r").isNull(), F.col("_r.since")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_f", F.last("_r", True).over(order)).where("_p is not null")
    final = ramps.groupBy("series_id").agg(F.max(F.struct(F.col("start").alias("since"), F.col("end").alias("until"), "ramp")).alias("_l"), F.count("*").alias("_m"))
    found = found.join(final, "series_id", "left")
    late = F.col("_f").isNull() & (F.col("_at") > F.col("_l.until"))
    pick = lambda name, other: F.when(late, other).otherwise(F.col(f"_f.{name}")).alias(name)
    return found.select("series_id", "_p.*", pick("ramp", F.col("_l.ramp")), pick("since", F.col("_l.since")), pick("until", F.col("_l.until")), pick("before", (F.col("_m") - 1).cast("int")))


def ramp_labels(points: DataFrame, ramps: DataFrame, chunk: int = 1 << 14) -> DataFrame:
    """``points`` with ``state``: 1 inside a ramp [start, end), else 0 and 2 by turns, 0 before the first ramp."""
    rows = with_latest_ramp(points, ramps, chunk=chunk)
    inside = F.col("t") < F.col("until")
    state = F.when(F.col("ramp").isNull(), 0).when(inside, 1).otherwise(((F.col("before") + 1) % 2) * 2)
    return rows.withColumn("state", state.cast("int")).drop("ramp", "since", "until", "before")


def inside_ramps(points: DataFrame, ramps: DataFrame, chunk: int = 1 << 14) -> DataFrame:
    """Points strictly inside a ramp, start < t < end, with that ramp; ramps don't overlap."""
    return with_latest_ramp(points, ramps, strict=True, chunk=chunk).where("t < until").select(*points.columns, "ramp")


def first_hits(points: DataFrame, ramps: DataFrame, chunk: int = 1 << 14) -> DataFrame:
    """series_id, ramp, t: the first point strictly inside each ramp that has one."""
    return inside_ramps(points, ramps, chunk).groupBy("series_id", "ramp").agg(F.min("t").alias("t"))


def crop_windows(ramps: DataFrame, length: Column, count: int = 4) -> DataFrame:
    """series_id, ramp, low, high: from before each ramp to after the ``count`` - 1 ramps that begin there.

    The margins are a third of the state on either side, twice the transition
    length at most; a state after the last ramp counts as four lengths.
    """
    order = Window.partitionBy("series_id").orderBy("start")
    rows = ramps.withColumn("_len", length).withColumn("_before", F.coalesce(F.lag("end").over(order), F.lit(0).cast("long")))
    rows = rows.withColumn("_stop", F.lead("end", count - 2).over(order)).withColumn("_after", F.lead("start", count - 1).over(order))
    room = F.coalesce(F.col("_after"), F.col("_stop") + 4 * F.col("_len")) - F.col("_stop")
    margin = lambda gap: F.least(2 * F.col("_len"), F.floor(gap / 3))
    return rows.where("_stop is not null").select(
        "series_id", "ramp", (F.col("start") - margin(F.col("start") - F.col("_before"))).cast("long").alias("low"), (F.col("_stop") + margin(room)).cast("long").alias("high")
    )
