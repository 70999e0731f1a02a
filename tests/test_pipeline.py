"""Statistics, runs and change points against hand-made and NumPy results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftline.operators import nulls, thresholds, windows

GOLDEN = [0.0] * 6 + [4.0] * 6 + [0.0] * 6 + [8.0] * 6


def series(spark, x, name="a"):
    return spark.createDataFrame([(name, t, float(v), len(x)) for t, v in enumerate(x)], "series_id string, t long, x double, n long")


def w2(x, w):
    x, g = np.asarray(x, float), np.zeros(len(x))
    for t in range(w, len(x) - w):
        g[t] = np.sqrt(((np.sort(x[t - w : t]) - np.sort(x[t : t + w])) ** 2).mean())
    return g


def values(df, column="g"):
    return [r[column] for r in df.orderBy("t").collect()]


def test_golden_statistic(spark):
    g = values(windows.metric_derivative(series(spark, GOLDEN), 3))
    want = [0, 0, 0, 0, 2.309401077, 3.265986324, 4, 3.265986324, 2.309401077, 0, 2.309401077, 3.265986324, 4, 3.265986324, 2.309401077, 0]
    want += [4.618802154, 6.531972647, 8, 6.531972647, 4.618802154, 0, 0, 0]
    assert g == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("q, points, runs", [(0.5, [0, 5, 6, 11, 12, 23], [(5, 7), (11, 13)]), (0.75, [0, 23], [])])
def test_golden_change_points(spark, q, points, runs):
    stat = windows.metric_derivative(series(spark, GOLDEN), 3)
    cuts = thresholds.quantile_cutoffs(stat, [q])
    assert sorted(r.t for r in thresholds.change_points(stat, cuts).collect()) == points
    assert sorted((r.start, r.end) for r in thresholds.find_runs(stat, cuts).collect()) == runs


def test_noiseless_trajectory(spark):
    """Two levels joined by ramps of ten; the last run is dropped, so 18 of 19 are found."""
    gt = [0, 105, 115, 270, 280, 685, 695, 866, 876, 1298, 1308, 1446, 1456, 1880, 1890, 1990, 2000, 2142, 2152, 2285, 2295, 2404, 2414]
    gt += [2747, 2757, 2873, 2883, 3592, 3602, 3960, 3970, 4224, 4234, 4343, 4353, 4618, 4628, 4938, 4948, 5190]
    x, at, level = [], 0, (100.0, 200.0)
    for k in range(0, 38, 2):
        here, there = level[(k // 2) % 2], level[(k // 2 + 1) % 2]
        x += [here] * (gt[k + 1] - at) + [there + (1 - j / 11) * (here - there) for j in range(1, 11)]
        at = gt[k + 2]
    x += [level[1]] * (gt[39] - at)
    stat = windows.metric_derivative(series(spark, x), 25)
    found = thresholds.change_points(stat, thresholds.quantile_cutoffs(stat, [0.95]))
    got = sorted(r.t for r in found.where(f"t > 0 and t < {len(x) - 1}").collect())
    assert len(got) == 36 and got[:8] == [104, 115, 269, 280, 684, 695, 865, 876]


def test_chunks_do_not_change_results(spark, monkeypatch):
    x = np.random.default_rng(0).normal(size=700)
    monkeypatch.setattr(windows.chunked, "__defaults__", (64,))
    for w in (5, 25, 60):
        assert values(windows.metric_derivative(series(spark, x), w)) == pytest.approx(w2(x, w), abs=1e-8)
    stat = windows.metric_derivative(series(spark, x), 5)
    assert values(windows.gradient(stat), "grad") == pytest.approx(np.gradient(np.round(w2(x, 5), 9)), abs=1e-8)


def test_periodic_statistic(spark):
    rng, w = np.random.default_rng(1), 4
    x = rng.random(24)
    got = values(windows.metric_derivative(series(spark, x), w, periodic=True))
    for t in range(w, 24 - w):
        a, b = np.sort(x[t - w : t]), np.sort(x[t : t + w])
        long = np.concatenate([b - 1, b, b + 1])
        best = min(((a - long[k : k + w]) ** 2).mean() for k in range(2 * w + 1))
        assert got[t] == pytest.approx(np.sqrt(best), abs=1e-8)


def test_short_series_is_zero(spark):
    assert values(windows.metric_derivative(series(spark, [1.0, 5.0, 2.0]), 2)) == [0, 0, 0]


def test_entropic_statistic_sees_a_flip(spark):
    from riftline.operators.generators import correlation_flip

    rows = correlation_flip(spark, 300, 150).select(F.lit("f").alias("series_id"), "t", F.array("x1", "x2").alias("x"), F.lit(300).cast("long").alias("n"))
    g = np.array(values(windows.entropic_derivative(rows, 40)))
    assert abs(int(g.argmax()) - 150) <= 15


def test_unit_blocks_resample_points(spark):
    s = series(spark, range(50))
    rows = nulls.block_bootstrap(s, 2, 1).collect()
    assert len(rows) == 100 and {r.x for r in rows} <= set(range(50))
    perm = nulls.permuted(s, 2).groupBy("series_id").agg(F.sort_array(F.collect_list("x")).alias("x")).collect()
    assert all(r.x == list(range(50)) for r in perm)


def test_autocorrelation_time():
    rng = np.random.default_rng(3)
    x = np.zeros(20000)
    for t in range(1, len(x)):
        x[t] = 0.8 * x[t - 1] + rng.normal()
    assert nulls.integrated_time(x)[0] == pytest.approx(9, rel=0.25)
    assert nulls.integrated_time(np.ones(10)) == (1.0, 0)


def test_runs_across_chunks(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=400).cumsum()
    stat = windows.metric_derivative(series(spark, x), 6)
    cuts = thresholds.quantile_cutoffs(stat, [0.3, 0.6])
    whole = sorted(map(tuple, thresholds.find_runs(stat, cuts).collect()))
    monkeypatch.setattr(thresholds, "CHUNK", 9)
    assert sorted(map(tuple, thresholds.find_runs(stat, cuts).collect())) == whole and len(whole) > 3


def test_quantiles_by_histogram(spark):
    rng = np.random.default_rng(6)
    a, b = series(spark, rng.normal(size=500).round(2)), series(spark, [1.0] * 30, "b")
    stat = a.union(b).withColumnRenamed("x", "g")
    levels = [0.0, 0.1, 0.5, 0.953, 1.0]
    plain, large = (sorted(map(tuple, f(stat, levels).collect())) for f in (thresholds.quantile_cutoffs, lambda s, q: thresholds.large_quantile_cutoffs(s, q, 16)))
    assert [x[:2] for x in plain] == [x[:2] for x in large]
    assert [x[2] for x in plain] == pytest.approx([x[2] for x in large], abs=1e-8)
