"""Ramps, windows and report tables against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftline.operators import pipelines, projections, tables, thresholds, windows
from riftline.operators import nulls

RAMPS = [(3, 6), (10, 11), (20, 29), (64, 70)]


def ramps(spark):
    return spark.createDataFrame([(g, k, a + d, b + d) for g, d in (("a", 0), ("b", 5)) for k, (a, b) in enumerate(RAMPS)], "series_id string, ramp long, start long, end long")


@pytest.mark.parametrize("chunk", [7, 16, 1 << 14])
def test_ramp_joins(spark, chunk):
    points = spark.createDataFrame([(g, t) for g in "abc" for t in range(120)], "series_id string, t long")
    state = {(r.series_id, r.t): r.state for r in projections.ramp_labels(points, ramps(spark), chunk).collect()}
    hits = {(r.series_id, r.ramp): r.t for r in projections.first_hits(points.where("t % 4 = 0"), ramps(spark), chunk).collect()}
    want_hits = {}
    for g, d in (("a", 0), ("b", 5)):
        for t in range(120):
            inside = any(a + d <= t < b + d for a, b in RAMPS)
            assert state[g, t] == (1 if inside else 2 * (sum(b + d <= t for _, b in RAMPS) % 2)), (g, t)
        for k, (a, b) in enumerate(RAMPS):
            found = [t for t in range(0, 120, 4) if a + d < t < b + d]
            if found:
                want_hits[g, k] = found[0]
    assert hits == want_hits and all(state["c", t] == 0 for t in range(120))


def test_window_settings(spark):
    rows = spark.createDataFrame([("oracle", 0), ("oracle", 7), ("w25", 7)], "s string, n int")
    assert [r.w for r in rows.select(projections.window_of(F.col("s"), F.col("n")).alias("w")).collect()] == [2, 14, 25]
    with pytest.raises(Exception, match="unknown window setting"):
        rows.select(projections.window_of(F.lit("wide"), F.col("n")).alias("w")).collect()


def series(spark, x, name="a"):
    return spark.createDataFrame([(name, t, float(v), len(x)) for t, v in enumerate(x)], "series_id string, t long, x double, n long")


def plain_points(g, cutoff, rule):
    """Boundaries read run by run, straight from the definition."""
    grad, above = np.gradient(g), np.flatnonzero(g > cutoff)
    runs = [r for r in np.split(above, np.flatnonzero(np.diff(above) > 1) + 1) if len(r)][:-1]
    out = set()
    for r in runs:
        if len(r) < 2:
            continue
        body = r[:-1]
        if rule == "gradient":
            out |= {int(body[np.argmin(grad[body])]), int(body[np.argmax(grad[body])])}
        elif rule == "run_edge":
            out |= {int(r[0]), int(r[-1])}
        elif rule == "peak":
            out |= {int(body[np.argmax(g[body])])}
        else:
            high = body[g[body] >= (g[body].min() + g[body].max()) / 2]
            out |= {int(high[0]), int(high[-1])}
    return out | (set() if rule == "peak" else {0, len(g) - 1})


@pytest.mark.parametrize("chunk", [13, 64])
def test_runs_across_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(thresholds, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    x = np.concatenate([rng.normal(6 * (k % 2), 1, 45) for k in range(12)])
    stat = pipelines.staged(windows.metric_derivative(series(spark, x), 10), "test-statistic")
    g = np.array([r.g for r in stat.orderBy("t").collect()])
    for level in (0.3, 0.7):
        cuts = thresholds.quantile_cutoffs(stat, [level])
        cutoff = cuts.first().cutoff
        for rule in ("gradient", "run_edge", "half_max", "peak"):
            got = {r.t for r in thresholds.change_points(stat, cuts, rule).collect()}
            assert got == plain_points(g, cutoff, rule), (rule, level)


def test_autocorrelation_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(windows.chunked, "__defaults__", (50,))
    x = np.cumsum(np.random.default_rng(3).normal(size=300))
    c = x - x.mean()
    got = {r.lag: r.rho for r in nulls.autocorrelation(series(spark, x), 20).collect()}
    assert set(got) == set(range(21)) and all(got[k] == pytest.approx((c[: 300 - k] @ c[k:]) / (c @ c)) for k in got)


def test_block_lengths_by_series(spark):
    rows = series(spark, range(40), "a").union(series(spark, range(40), "b"))
    lengths = spark.createDataFrame([("a", 1), ("b", 20)], "series_id string, block_length int")
    out = nulls.block_bootstrap(rows, 2, lengths).collect()
    steps = {}
    for r in sorted(out, key=lambda r: (r.series_id, r.t)):
        steps.setdefault((r.series_id.series_id, r.series_id.rep), []).append(r.x)
    together = {k: np.mean(np.mod(np.diff(v), 40) == 1) for k, v in steps.items()}
    assert all(len(v) == 40 for v in steps.values()) and all((s > 0.9) == (k[0] == "b") for k, s in together.items())


def test_cutoff_rules_are_known(spark):
    with pytest.raises(ValueError):
        pipelines.cutoffs_by("median", None, 5, 0.5)
    with pytest.raises(ValueError):
        pipelines.cluster_trajectory(None, 5, 0.5, "median")


def test_numeric_suffixes():
    assert tables.by_suffix(["f1_tau50", "sigma", "f1_tau5", "f1_tau10", "f1_taux"], "f1_tau") == ["f1_tau5", "f1_tau10", "f1_tau50"]


def test_rounding_is_half_even(spark):
    rows = spark.createDataFrame([(0.125,), (0.375,)], "v double")
    assert [r.v for r in tables.rounded(rows, 2).collect()] == [0.12, 0.38]
