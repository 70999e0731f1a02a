"""Sliding two-sample statistics over long series tables (series_id, t, x, n).

A series is cut into chunks of time and each chunk is given the ``w`` samples on
either side, so one endless series is many tasks; every window function then
runs inside (series_id, chunk).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK = 1 << 14
KEY = ["series_id", "_chunk"]


def chunked(series: DataFrame, halo: int, chunk: int = CHUNK) -> DataFrame:
    """Rows repeated into every chunk whose halo they lie in; ``_own`` marks the one that keeps the row."""
    size = max(chunk, 2 * halo)
    own = F.floor(F.col("t") / size)
    reach = F.sequence(F.floor((F.col("t") - halo) / size), F.floor((F.col("t") + halo) / size))
    return series.withColumn("_chunk", F.explode(reach)).withColumn("_own", F.col("_chunk") == own)


def frames(w: int):
    order = Window.partitionBy(*KEY).orderBy("t")
    return order.rowsBetween(-w, -1), order.rowsBetween(0, w - 1)


def inside(w: int):
    return (F.col("t") >= w) & (F.col("t") < F.col("n") - w)


def _statistic(series: DataFrame, w: int, value) -> DataFrame:
    rows = chunked(series, w)
    g = F.when(inside(w), F.round(value(*frames(w)), 9)).otherwise(F.lit(0.0))
    return rows.withColumn("g", g).where("_own").drop("_own", "_chunk")


def sorted_windows(x, w: int):
    """A row for each run of ``w`` samples, sorted."""
    import numpy as np

    return np.sort(np.lib.stride_tricks.sliding_window_view(x, w), axis=1)


def merged(a: list, b: list) -> list:
    """Batcher's odd-even merge of two sorted lists of vectors, place by place."""
    import numpy as np

    if not a or not b:
        return a or b
    if len(a) == len(b) == 1:
        return [np.minimum(a[0], b[0]), np.maximum(a[0], b[0])]
    even, odd = merged(a[::2], b[::2]), merged(a[1::2], b[1::2])
    out = even[:1]
    for p, q in zip(odd, even[1:]):
        out += [np.minimum(p, q), np.maximum(p, q)]
    return out + odd[len(even) - 1 :] + even[len(odd) + 1 :]


def merged_windows(x, w: int) -> list:
    """The least, second, ... of each run of ``w`` samples, a vector for each rank: windows are merged of windows half as long."""
    size, run, out, done = 1, [x], [], 0
    while True:
        if w & size:  # this power's samples stand before those of the smaller ones
            places = len(x) - done - size + 1
            out = merged([v[:places] for v in run], [v[size : size + places] for v in out])
            done += size
        if 2 * size > w:
            return out
        run = merged([v[:-size] for v in run], [v[size:] for v in run])
        size *= 2


def added(v: list):
    """The sum of vectors in the order in which NumPy adds up a row."""
    if len(v) < 8:
        out = v[0]
        for x in v[1:]:
            out = out + x
        return out
    if len(v) > 128:
        half = len(v) // 2 - len(v) // 2 % 8
        return added(v[:half]) + added(v[half:])
    r, whole = v[:8], len(v) - len(v) % 8
    for i in range(8, whole, 8):
        r = [a + b for a, b in zip(r, v[i : i + 8])]
    out = ((r[0] + r[1]) + (r[2] + r[3])) + ((r[4] + r[5]) + (r[6] + r[7]))
    for x in v[whole:]:
        out = out + x
    return out


#: Windows up to this width are merged, ``PLACES`` at a time; wider ones and those with NaN are sorted.
MERGED, PLACES = 64, 4096


def line_gaps(x, w: int):
    """W2 of the ``w`` samples before and from each place ``w``, ``w + 1`` ... that has so many on both sides."""
    import numpy as np

    if w > MERGED or np.isnan(x).any():
        s = sorted_windows(x, w)
        return np.sqrt(((s[w:] - s[:-w]) ** 2).sum(1) / w)
    out = np.empty(len(x) - 2 * w + 1)
    for lo in range(0, len(out), PLACES):
        part = merged_windows(x[lo : lo + PLACES + 2 * w - 1], w)
        gaps = [v[w:] - v[:-w] for v in part]
        out[lo : lo + PLACES] = added([g * g for g in gaps])
    return np.sqrt(out / w)


def circle_gaps(x, w: int):
    """The same on the circle of length one, for samples in [0, 1).

    An optimal plan is monotone up to a cyclic shift k of the sorted samples, the
    values that pass the end wrapped by one. Cost(k) for all shifts at once: the
    squares don't depend on the pairing but for wrapped values, and the products
    are a circular correlation.
    """
    import numpy as np

    s = sorted_windows(x, w)
    a, b = s[:-w], s[w:]
    longer = np.hstack([b - 1, b, b + 1])
    squares = np.cumsum(np.hstack([np.zeros((len(b), 1)), longer**2]), axis=1)
    best = np.full(len(a), np.inf)
    own = (a * a).sum(1)
    for k in range(2 * w + 1):
        cost = own + squares[:, k + w] - squares[:, k] - 2 * np.einsum("ij,ij->i", a, longer[:, k : k + w])
        np.minimum(best, cost, out=best)
    return np.sqrt(np.maximum(best, 0) / w)


#: Samples sorted at a time: bounds a task's memory at some times this many doubles.
SORTED = 1 << 21


def metric_derivative(series: DataFrame, w: int, periodic: bool = False) -> DataFrame:
    """W2 of the ``w`` samples before and from each ``t``; 0 in the first and last ``w`` places. Adds ``g``, ``grad``.

    A window is sorted once, as the right one of its first place and the left one
    of the place after it, for a chunk at a time in one array operation. ``grad``:
    central differences of ``g``, one-sided at the ends. A null sample makes the
    statistic of the places that see it NaN.
    """
    gaps = circle_gaps if periodic else line_gaps
    rows = chunked(series.select("series_id", "t", F.col("x").cast("double").alias("x"), "n"), w + 1)

    def kernel(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("t")
        x, t, own = (table.column(c).to_numpy() for c in ("x", "t", "_own"))
        n = int(table.column("n")[0].as_py())
        g = np.zeros(len(x))
        step = max(1, SORTED // w)
        for lo in range(w, len(x) - w + 1, step):
            hi = min(lo + step, len(x) - w + 1)
            g[lo:hi] = np.round(gaps(x[lo - w : hi + w - 1], w), 9)
        g[(t < w) | (t >= n - w)] = 0.0
        keep = np.flatnonzero(own)
        if n > 1:
            before, after = np.maximum(keep - 1, 0), np.minimum(keep + 1, len(x) - 1)
            grad = (g[after] - g[before]) / np.maximum(after - before, 1)
        else:
            grad = np.zeros(len(keep))
        kept = table.select(["series_id", "t", "x", "n"]).take(pa.array(keep))
        return kept.append_column("g", pa.array(g[keep])).append_column("grad", pa.array(grad))

    out = StructType([series.schema["series_id"], *StructType.fromDDL("t long, x double, n long, g double, grad double")])
    return rows.groupBy(*KEY).applyInArrow(kernel, out)


def mean_shift(series: DataFrame, w: int) -> DataFrame:
    """Absolute difference of the two window means; same padding. Adds ``g``."""
    return _statistic(series, w, lambda left, right: F.abs(F.avg("x").over(right) - F.avg("x").over(left)))


STATISTICS = {"w2": metric_derivative, "mean": mean_shift}


def statistic(kind: str, series: DataFrame, w: int) -> DataFrame:
    if kind not in STATISTICS:
        raise ValueError(f"unknown statistic {kind!r}")
    return STATISTICS[kind](series, w)


def gradient(stat: DataFrame, column: str = "g", out: str = "grad") -> DataFrame:
    """Central differences, one-sided at the ends, for a statistic that has none yet."""
    if out in stat.columns:
        return stat
    rows = chunked(stat, 1)
    order = Window.partitionBy(*KEY).orderBy("t")
    before, after = F.lag(column).over(order), F.lead(column).over(order)
    here = F.col(column)
    value = (
        F.when(F.col("n") == 1, F.lit(0.0))
        .when(F.col("t") == 0, after - here)
        .when(F.col("t") == F.col("n") - 1, here - before)
        .otherwise((after - before) / 2)
    )
    return rows.withColumn(out, value).where("_own").drop("_own", "_chunk")


def rolling_mean(series: DataFrame, width: int, least: int, column: str = "x", out: str = "mean") -> DataFrame:
    """Centred mean of ``width`` samples where at least ``least`` are there, else null."""
    half = width // 2
    frame = Window.partitionBy(*KEY).orderBy("t").rowsBetween(-half, half)
    rows = chunked(series, half)
    value = F.when(F.count(column).over(frame) >= least, F.avg(column).over(frame))
    return rows.withColumn(out, value).where("_own").drop("_own", "_chunk")


def observed_quantile(stat: DataFrame, cutoffs: DataFrame, w: int) -> DataFrame:
    """Share of the statistic's valid places at or below each series' ``cutoff``."""
    valid = stat.where(inside(w)).join(F.broadcast(cutoffs), "series_id")  # a row a series and level
    return valid.groupBy("series_id", "q").agg(F.avg((F.col("g") <= F.col("cutoff")).cast("int")).alias("obs_quantile"))


def entropic_derivative(series: DataFrame, w: int, reg: float = 0.05, iterations: int = 200) -> DataFrame:
    """Entropic W2 of joint windows of vectors ``x``: log-domain scaling, transport cost without the entropy term."""
    rows = chunked(series, w, 256)  # a place costs w^2 times the iterations: short chunks, many tasks

    def kernel(pdf):
        import numpy as np

        pdf = pdf.sort_values("t")
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        x = x.reshape(len(x), -1)
        t, n = pdf["t"].to_numpy(), pdf["n"].to_numpy()
        g = np.zeros(len(x))
        todo = [i for i in np.flatnonzero(pdf["_own"].to_numpy()) if t[i] >= w and t[i] < n[i] - w]
        for at in range(0, len(todo), 64):
            run = todo[at : at + 64]
            a, b = np.stack([x[i - w : i] for i in run]), np.stack([x[i : i + w] for i in run])
            cost = ((a[:, :, None, :] - b[:, None, :, :]) ** 2).sum(-1)
            k, lw = -cost / reg, -np.log(w)
            f, h = np.zeros((len(run), w, 1)), np.zeros((len(run), 1, w))
            for _ in range(iterations):
                m = (k + h).max(2, keepdims=True)
                f = lw - m - np.log(np.exp(k + h - m).sum(2, keepdims=True))
                m = (k + f).max(1, keepdims=True)
                h = lw - m - np.log(np.exp(k + f - m).sum(1, keepdims=True))
            g[run] = np.sqrt(np.maximum((np.exp(k + f + h) * cost).sum((1, 2)), 0))
        return pdf.assign(g=g)[pdf["_own"]][["series_id", "t", "g"]]

    kind = series.schema["series_id"].dataType.simpleString()
    return rows.groupBy(*KEY).applyInPandas(kernel, f"series_id {kind}, t long, g double")
