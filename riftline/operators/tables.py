"""Report tables over result frames (a row for each fitted setting), as DataFrames in output order.

Bins are right-closed. Means and medians leave nulls out; null group keys are
kept only where it is said. Tables are rounded half-even.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import reports as R

#: Edges and labels of the transition-length bins of the three kinds of reports.
LENGTHS = ([0, 10, 25, 50, 75, 100], ["1-10", "11-25", "26-50", "51-75", "76-100"])
FIFTHS = ([0, 20, 40, 60, 80, 101], ["(0, 20]", "(20, 40]", "(40, 60]", "(60, 80]", "(80, 101]"])
QUARTERS = ([0, 25, 50, 75, 101], ["(0, 25]", "(25, 50]", "(50, 75]", "(75, 101]"])
#: Fixed value: the transition lengths shown in the threshold diagnosis.
SHOWN_LENGTHS = [1, 5, 10, 20, 40, 60, 80, 100]


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    """Every double column to so many digits, halves to even."""
    return df.withColumns({c: F.bround(F.col(f"`{c}`"), digits) for c, kind in df.dtypes if kind == "double"})


def by_suffix(columns: list[str], prefix: str) -> list[str]:
    """The columns ``prefix``N, by the number N."""
    found = [(int(m[1]), c) for c in columns if (m := re.fullmatch(re.escape(prefix) + r"(\d+)", c))]
    return [c for _, c in sorted(found)]


def ordinal(column: str, order: list[str]) -> Column:
    """The place of a category in its order, for sorting; unknown ones last."""
    out = F.lit(len(order))
    for k, v in reversed(list(enumerate(order))):
        out = F.when(F.col(column) == v, k).otherwise(out)
    return out


def binned(df: DataFrame, bins, include_lowest: bool = False, column: str = "transition_length") -> DataFrame:
    return df.withColumn("tl_bin", R.cut(F.col(column), *bins, include_lowest=include_lowest))


def means(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


# --- detection -----------------------------------------------------------------


def detection(df: DataFrame) -> DataFrame:
    """Mean F1 at each tolerance, by estimator and window."""
    return means(df, ["estimator", "window_setting"], by_suffix(df.columns, "f1_tau"))


def localisation_by_length(df: DataFrame) -> DataFrame:
    """Median errors by estimator and transition-length bin, a column for each error and bin."""
    rows = binned(df, LENGTHS, include_lowest=True)
    cell = lambda c, b: F.median(F.when(F.col("tl_bin") == b, F.col(c))).alias(f"{c} {b}")
    return rows.groupBy("estimator").agg(*[cell(c, b) for c in ("median_abs_error", "median_signed_error") for b in LENGTHS[1]])


def estimator_gaps(df: DataFrame, pairs=(("gradient", "run_edge"), ("gradient", "half_max"), ("run_edge", "half_max"))) -> DataFrame:
    """How far the rules' errors are apart: mean, median and 90th percentile by pair of rules."""
    arm = lambda e: F.avg(F.when(F.col("estimator") == e, F.col("median_abs_error")))
    wide = df.groupBy("window_setting", "sigma", "transition_length").agg(*[arm(e).alias(e) for e in sorted({e for p in pairs for e in p})])
    gaps = wide.select(F.explode(F.array(*[F.struct(F.lit(f"{a} vs {b}").alias("pair"), F.abs(F.col(a) - F.col(b)).alias("gap")) for a, b in pairs])).alias("r")).select("r.*")
    return gaps.groupBy("pair").agg(F.avg("gap").alias("mean_gap"), F.median("gap").alias("median_gap"), F.percentile("gap", 0.9).alias("p90_gap"))


def by_bin(df: DataFrame, keys: list[str], value: str, bins, include_lowest: bool = False) -> DataFrame:
    """Means of a column, a row for each group of ``keys`` and a column for each bin of the transition length."""
    return binned(df, bins, include_lowest).groupBy(*keys).pivot("tl_bin", bins[1]).agg(F.avg(value))


def window_choice(df: DataFrame) -> DataFrame:
    return by_bin(df.where("estimator = 'gradient'"), ["window_setting"], "f1_tau50", LENGTHS, True)


def best_thresholds(thr: DataFrame) -> DataFrame:
    """The level of least error of each trajectory, the lowest of equal ones."""
    return R.arg_row(thr, ["sigma", "transition_length"], "median_abs_error", ["q"])


def threshold_diagnosis(thr: DataFrame, shown=SHOWN_LENGTHS, fixed: float = 0.95) -> DataFrame:
    """Medians over the noise levels of the best level, the expected one and the error there, and the error at a fixed level."""
    best = best_thresholds(thr).groupBy("transition_length").agg(F.median("q").alias("best_q"), F.median("q_star").alias("q_star"), F.median("median_abs_error").alias("error_at_best"))
    near = F.abs(F.col("q") - fixed) <= 1e-8 + 1e-5 * fixed
    at_fixed = thr.where(near).groupBy("transition_length").agg(F.median("median_abs_error").alias("error_at_fixed"))
    return best.where(F.col("transition_length").isin(*shown)).join(at_fixed, "transition_length", "left")


def prior_tests(df: DataFrame, against: str, keys: list[str], value: str = "f1_tau25") -> DataFrame:
    """keys, rho, n, mean: rank correlation of the score with a condition, gradient rule only; null where either is constant."""
    rows = df.where("estimator = 'gradient'")
    rho = R.spearman(rows, against, value, keys)
    return rho.join(rows.groupBy(*keys).agg(F.avg(value).alias("mean")), keys)


def with_p_value(rows: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """Adds ``p_value``, two-sided, to a report of correlations."""
    p = F.udf(lambda r, k: None if r is None else R.correlation_p(r, k), "double")  # a row a report line
    return rows.withColumn("p_value", p(F.col(rho), F.col(n)))


# --- clustering quality ----------------------------------------------------------


def quality_by_noise(df: DataFrame, columns: dict[str, str], failed: bool = False) -> DataFrame:
    """sigma, n, (n_failed) and means, new name by column."""
    out = [F.count("*").alias("n")]
    if failed:
        out.append(F.sum((F.col("status") != "ok").cast("int")).alias("n_failed"))
    return df.groupBy("sigma").agg(*out, *[F.avg(c).alias(name) for name, c in columns.items()])


def quality_by_length(df: DataFrame, columns: list[str]) -> DataFrame:
    """Means by noise level and bin, of fitted noisy trajectories."""
    rows = binned(df.where("status = 'ok' and sigma > 0"), FIFTHS)
    return rounded(means(rows, ["sigma", "tl_bin"], columns))


def localisation_gap(df: DataFrame, found: str = "adp_v3", oracle: str = "oracle_v3") -> DataFrame:
    """How much of the distance from a perfect score goes back to the change points."""
    rows = df.where("status = 'ok' and sigma > 0").dropna(subset=[oracle])
    gap = F.avg(F.col(oracle) - F.col(found))
    out = rows.groupBy("sigma").agg(F.count("*").alias("n"), F.avg(found).alias("found"), F.avg(oracle).alias("oracle"), gap.alias("gap"), (gap / F.nullif(1 - F.avg(found), F.lit(0.0))).alias("frac_of_shortfall"))
    return rounded(out)


def win_rates(df: DataFrame, arms: dict[str, str], rival: str) -> DataFrame:
    """sigma, n and for each arm the share of its scored trajectories on which it is below the rival."""
    wins = lambda c: F.sum(F.coalesce((F.col(c) < F.col(rival)).cast("int"), F.lit(0)))
    out = df.where("status = 'ok'").groupBy("sigma").agg(F.count("*").alias("n"), *[(wins(c) / F.nullif(F.count(c), F.lit(0))).alias(name) for name, c in arms.items()])
    return rounded(out)


# --- thresholds by window ----------------------------------------------------------


def best_by_window(df: DataFrame, arm: str, metric: str = "f1_tau10") -> DataFrame:
    """arm, w, best_q, f1: the best level of each window, and of the worst case over windows; the lowest of equal ones."""
    cells = df.groupBy("w", "q").agg(F.avg(metric).alias("f1"))
    worst = cells.groupBy("q").agg(F.min("f1").alias("f1")).withColumn("w", F.lit("worst case"))
    rows = cells.select(F.col("w").cast("string").alias("w"), "q", "f1").unionByName(worst)
    best = R.arg_row(rows, ["w"], "f1", ["q"], largest=True)
    return rounded(best.select(F.lit(arm).alias("arm"), "w", F.col("q").alias("best_q"), F.col("f1").alias("f1_at_best_q")))


def cutoff_alignment(df: DataFrame, level: float = 0.5, against: float = 0.75) -> DataFrame:
    """w, null_cutoff, observed_quantile, baseline_cutoff: where the null's cutoff lies on the statistic's own scale of levels."""
    mid = df.groupBy("method", "w", "q").agg(F.median("cutoff").alias("cutoff"))
    observed = mid.where("method = 'baseline'")
    null = mid.where("method = 'resample_pointwise'").where(F.abs(F.col("q") - level) < 1e-9).select("w", F.col("cutoff").alias("c"))
    at = R.interpolate(observed.select("w", "cutoff", "q"), null, "cutoff", "q", ["w"], "c")
    base = observed.where(F.abs(F.col("q") - against) < 1e-9).select("w", F.col("cutoff").alias("baseline_cutoff"))
    return rounded(at.join(base, "w", "left").select("w", F.col("c").alias("null_cutoff"), F.col("q").alias("observed_quantile"), "baseline_cutoff"))


# --- bandwidths ----------------------------------------------------------------------


def sigma_rules(grid: DataFrame, median_rule: DataFrame, columns: list[str], code: float = 0.5, paper: float = 1.0) -> DataFrame:
    """noise_sigma, rule and means of four ways to choose a bandwidth: two fixed ones, the median heuristic, the best of each trajectory."""
    pick = {"fixed (code)": grid.where(F.abs(F.col("sigma") - code) < 1e-9), "fixed (paper)": grid.where(F.abs(F.col("sigma") - paper) < 1e-9), "median heuristic": median_rule}
    pick["best (ceiling)"] = R.arg_row(grid, ["noise_sigma", "transition_length"], "v3", ["sigma"], largest=True)
    parts = [rows.groupBy("noise_sigma").agg(F.avg("sigma").alias("mean_sigma"), *[F.avg(c).alias(c) for c in columns]).withColumn("rule", F.lit(rule)) for rule, rows in pick.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


def eigengaps(grid: DataFrame) -> DataFrame:
    """By bandwidth, over noisy trajectories: how many clusters the eigengap finds, and the quality."""
    k = F.col("eigengap_k")
    out = grid.where("noise_sigma > 0").groupBy("sigma").agg(F.median(k.cast("double")).alias("k_median"), F.avg(k).alias("k_mean"), F.avg((k == 3).cast("int")).alias("frac_k_eq_3"), F.avg("v3").alias("v3"), F.avg("ari").alias("ari"))
    return rounded(out)


# --- detectors -------------------------------------------------------------------------

CELL = ["kind", "separation", "transition_length", "w", "detector", "extractor"]


def best_levels(df: DataFrame, metric: str = "f1_tau10") -> DataFrame:
    """CELL, mean, std, n at the level of largest mean score over the repetitions, the lowest of equal ones."""
    cells = df.groupBy(*CELL, "q").agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count("*").alias("n"))
    return R.arg_row(cells, CELL, "mean", ["q"], largest=True).drop("q")


def instantaneous(best: DataFrame, value: str, windows: list[int]) -> DataFrame:
    """kind, separation and a column for each window and detector, for changes without ramps."""
    rows = best.where("transition_length = 0 and extractor = 'peak'")
    cell = lambda w, d: F.avg(F.when((F.col("w") == w) & (F.col("detector") == d), F.col(value))).alias(f"w{w} {d}")
    return rounded(rows.groupBy("kind", "separation").agg(*[cell(w, d) for w in windows for d in ("mean", "w2")]))


def gradual(best: DataFrame, lengths: list[int], w: int = 50) -> DataFrame:
    rows = best.where("transition_length > 0 and extractor = 'gradient'").where(F.col("w") == w)
    cell = lambda n, d: F.avg(F.when((F.col("transition_length") == n) & (F.col("detector") == d), F.col("mean"))).alias(f"tl{n} {d}")
    return rounded(rows.groupBy("kind", "separation").agg(*[cell(n, d) for n in lengths for d in ("mean", "w2")]))


def head_to_head(best: DataFrame) -> DataFrame:
    """kind, w and the mean scores of both detectors over paired cells, and their mean difference."""
    arm = lambda d: F.avg(F.when(F.col("detector") == d, F.col("mean")))
    cells = best.groupBy("kind", "transition_length", "w", "extractor", "separation").agg(arm("w2").alias("w2"), arm("mean").alias("m"))
    return rounded(cells.groupBy("kind", "w").agg(F.avg("w2").alias("w2"), F.avg("m").alias("mean"), F.avg(F.col("w2") - F.col("m")).alias("w2_minus_mean")))


def window_dependence(best: DataFrame, windows: list[int]) -> DataFrame:
    rows = best.where("transition_length = 0 and extractor = 'peak'")
    return rounded(rows.groupBy("kind", "detector").agg(*[F.avg(F.when(F.col("w") == w, F.col("mean"))).alias(f"w{w}") for w in windows]))


# --- block nulls -------------------------------------------------------------------------


def scheme_robustness(df: DataFrame) -> DataFrame:
    """block_length and both schemes' observed quantiles and segment counts."""
    cell = lambda c, s: F.avg(F.when(F.col("scheme") == s, F.col(c))).alias(f"{c} {s}")
    out = df.where("scheme in ('circular', 'moving')").groupBy("block_length")
    return rounded(out.agg(*[cell(c, s) for c in ("cutoff_obs_quantile", "n_segments") for s in ("circular", "moving")]), 4)


def by_block_length(df: DataFrame, columns: list[str]) -> DataFrame:
    """Means by method and block length; rules without a block length keep their null key."""
    return rounded(means(df, ["method", "block_length"], columns))


def above_chance(observed: DataFrame, chance: DataFrame, keys: list[str]) -> DataFrame:
    """keys, recall, chance, above: observed mean recall beside what random points reach."""
    rows = observed.join(chance, keys)
    return rows.select(*keys, "recall", "chance", (F.col("recall") - F.col("chance")).alias("above"))


def page(df: DataFrame, order: list, offset: int, count: int) -> DataFrame:
    """Rows ``offset`` to ``offset + count`` of a total order."""
    return df.orderBy(*order).offset(offset).limit(count)


def with_inverse(rows: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    """``rows`` with ``distinct`` (number of the value among the group's distinct values, by first occurrence) and ``representative`` (its first row)."""
    first = rows.groupBy(*keys, value).agg(F.min(order).alias("representative"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("representative")) - 1
    return rows.join(first.withColumn("distinct", number.cast("long")), [*keys, value])
