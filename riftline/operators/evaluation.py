"""Scores of detections and clusterings composed of matchings, label counts and laws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from . import scoring as M


def true_points(ramps: DataFrame) -> DataFrame:
    """series_id, truth, side: both ends of every ramp, repeated where ramps meet."""
    ends = F.array(F.struct(F.col("start").alias("truth"), F.lit("start").alias("side")), F.struct(F.col("end").alias("truth"), F.lit("end").alias("side")))
    return ramps.select("series_id", F.explode(ends).alias("e")).select("series_id", "e.*")


def localisation(points: DataFrame, ramps: DataFrame, keys: list[str]) -> DataFrame:
    """``offset_stats`` whose signed offset counts forwards at the start of a ramp and backwards at its end.

    Of a start and an end at one place the start counts.
    """
    ends = true_points(ramps)
    side = ends.groupBy("series_id", "truth").agg(F.max((F.col("side") == "start").cast("int")).alias("_start"))
    rows = M.nearest(points, ends.select("series_id", "truth").distinct(), keys)
    rows = rows.join(side, ["series_id", "truth"])
    return M.offset_stats(rows.withColumn("offset", F.when(F.col("_start") == 1, F.col("offset")).otherwise(-F.col("offset"))), keys)


def matched(points: DataFrame, truth: DataFrame, tau: int, keys: list[str]) -> DataFrame:
    """keys, t, truth: the pairs of a largest one-to-one matching within ``tau`` of least total displacement.

    A group's points and truths can't interact across a gap of more than ``tau``:
    runs of them without such a gap are matched by themselves, some at a time.
    """
    both = points.select(*keys, F.col("t").alias("_x"), F.lit(True).alias("_p")).unionByName(truth.select(*keys, F.col("truth").alias("_x"), F.lit(False).alias("_p")))
    order = Window.partitionBy(*keys).orderBy("_x")
    gap = F.coalesce((F.col("_x") - F.lag("_x").over(order) > tau).cast("int"), F.lit(0))
    runs = both.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def kernel(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("_x")
        x, found, run = pdf["_x"].to_numpy(), pdf["_p"].to_numpy(), pdf["_run"].to_numpy()
        borders, pairs = np.flatnonzero(np.diff(run)) + 1, []
        for lo, hi in zip([0, *borders], [*borders, len(x)]):
            p, c = x[lo:hi][found[lo:hi]].tolist(), x[lo:hi][~found[lo:hi]].tolist()
            pairs += [(p[i], c[j]) for i, j in M.match_pairs(p, c, tau)] if p and c else []
        out = pd.DataFrame(pairs, columns=["t", "truth"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "t", "truth"]]

    return runs.withColumn("_some", F.floor(F.col("_run") / 256)).groupBy(*keys, "_some").applyInPandas(kernel, f"{kinds}, t long, truth long")


def ratio(a, b) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def pair_scores(points: DataFrame, truth: DataFrame, tau: int, keys: list[str]) -> DataFrame:
    """keys, precision, recall, f1, median_abs_error (of matched pairs, null without any). Points without trivial ones."""
    hits = matched(points, truth, tau, keys).groupBy(*keys).agg(F.count("*").alias("m"), F.median(F.abs(F.col("t") - F.col("truth"))).alias("median_abs_error"))
    found, wanted = points.groupBy(*keys).agg(F.count("*").alias("p")), truth.groupBy(*keys).agg(F.count("*").alias("c"))
    rows = wanted.join(found, keys, "full").join(hits, keys, "left").fillna(0, ["m", "p", "c"])
    precision, recall = ratio(F.col("m"), F.col("p")), ratio(F.col("m"), F.col("c"))
    return rows.select(*keys, precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), "median_abs_error")


def recall_by_size(points: DataFrame, truth: DataFrame, tau: int, keys: list[str]) -> DataFrame:
    """keys, small_recall, big_recall, precision. ``truth`` has ``size`` (small or big); null where there is nothing to divide by."""
    part = lambda size: truth.where(F.col("size") == size) if size else truth
    out = truth.select(*keys).union(points.select(*keys)).distinct()
    for size, name in (("small", "small_recall"), ("big", "big_recall"), (None, "precision")):
        hits = matched(points, part(size), tau, keys).groupBy(*keys).agg(F.count("*").alias("m"))
        of = (points if size is None else part(size)).groupBy(*keys).agg(F.count("*").alias("c"))
        share = of.join(hits, keys, "left").select(*keys, (F.coalesce("m", F.lit(0)) / F.col("c")).alias(name))
        out = out.join(share, keys, "left")
    return out


def classified(points: DataFrame, truth: DataFrame, tau: int, keys: list[str]) -> DataFrame:
    """``points`` with is_small, is_big, is_miss: matched one to one with small truths, with big ones (apart), or neither."""
    out = points
    for size in ("small", "big"):
        hits = matched(points, truth.where(F.col("size") == size), tau, keys).select(*keys, "t").distinct().withColumn(f"is_{size}", F.lit(True))
        out = out.join(hits, [*keys, "t"], "left").fillna(False, [f"is_{size}"])
    return out.withColumn("is_miss", ~(F.col("is_small") | F.col("is_big")))


def chance_recall(counts: DataFrame, truth: DataFrame, length: int, tau: int, trials: int, keys: list[str], seed: str = "2026") -> DataFrame:
    """keys, chance: mean recall of ``n`` uniform points in 1 .. length - 2, drawn by digests. ``counts``: keys, n."""
    draws = counts.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    draws = draws.withColumn("_k", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).otherwise(F.array())))
    text = F.md5(F.concat_ws("-", F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col("trial").cast("string"), F.col("_k").cast("string")))
    t = F.conv(F.substring(text, 1, 12), 16, 10).cast("long") % (length - 2) + 1
    points = draws.select(*keys, "trial", t.alias("t"))
    every = truth.join(counts.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")), keys)
    hits = matched(points, every, tau, [*keys, "trial"]).groupBy(*keys).agg(F.count("*").alias("m"))
    size = truth.groupBy(*keys).agg(F.count("*").alias("c"))
    return size.join(hits, keys, "left").select(*keys, (F.coalesce("m", F.lit(0)) / (F.col("c") * trials)).alias("chance"))


def two_targets(rows: DataFrame, truth: str, pred: str, keys: list[str], transition=1) -> DataFrame:
    """keys, v3, v2, k: V-measure with all states, without the transition state, and the number of labels."""
    three = M.v_measure(rows, truth, pred, keys).select(*keys, F.col("v").alias("v3"))
    two = M.v_measure(rows.where(F.col(truth) != F.lit(transition)), truth, pred, keys).select(*keys, F.col("v").alias("v2"))
    return three.join(two, keys, "left").join(rows.groupBy(*keys).agg(F.count_distinct(pred).alias("k")), keys)


def distributional_error(rows: DataFrame, truth: str, pred: str, keys: list[str], a, b, levels: int = 512) -> DataFrame:
    """keys, fidelity, coverage, separation, and the first two as shares of it. Separation: the distance of the laws of states ``a`` and ``b``."""
    true, found = M.laws(rows, truth, keys, levels), M.laws(rows, pred, keys, levels)
    errors = M.law_errors(true, found, truth, pred, keys)
    side = lambda state, name: true.where(F.col(truth) == F.lit(state)).select(*keys, F.col("profile").alias(name))
    gap = side(a, "_a").join(side(b, "_b"), keys).select(*keys, F.sqrt(A.squared_gap(F.col("_a"), F.col("_b")) / levels).alias("separation"))
    out = errors.join(gap, keys, "left")
    share = lambda c: F.when(F.col("separation") > 0, F.col(c) / F.col("separation")).alias(f"{c}_norm")
    return out.select(*keys, "fidelity", "coverage", "separation", share("fidelity"), share("coverage"))


def both_errors(rows: DataFrame, truth: str, pred: str, keys: list[str], a=0, b=2, transition=1, levels: int = 512) -> DataFrame:
    """``distributional_error`` with all states and without the transition state: names end in 3 and 2."""
    three = distributional_error(rows, truth, pred, keys, a, b, levels)
    two = distributional_error(rows.where(F.col(truth) != F.lit(transition)), truth, pred, keys, a, b, levels)
    named = lambda df, end: df.select(*keys, *[F.col(c).alias(f"{c}{end}") for c in df.columns if c not in keys])
    return named(three, 3).join(named(two, 2), keys, "left")


def cluster_report(rows: DataFrame, truth: str, pred: str, keys: list[str], levels: int = 512) -> DataFrame:
    """keys, cluster, mass, mean, std (of its profile), nearest (state; the smaller of equally near ones), w2."""
    true = M.laws(rows, truth, keys, levels).select(*keys, F.col(truth).alias("_state"), F.col("profile").alias("_t"))
    found = M.laws(rows, pred, keys, levels)
    d = F.sqrt(A.squared_gap(F.col("profile"), F.col("_t")) / levels)
    mean = A.sum_of(F.col("profile")) / levels
    std = F.sqrt(A.sum_of(F.transform("profile", lambda v: (v - F.col("mean")) * (v - F.col("mean")))) / levels)
    best = found.join(true, keys).groupBy(*keys, F.col(pred).alias("cluster")).agg(F.min(F.struct(d.alias("d"), "_state")).alias("n"), F.first("mass").alias("mass"), F.first("profile").alias("profile"))
    best = best.withColumn("mean", mean).withColumn("std", std)
    return best.select(*keys, "cluster", "mass", "mean", "std", F.col("n._state").alias("nearest"), F.col("n.d").alias("w2")).orderBy(*keys, F.col("mass").desc(), "cluster")


def composition(rows: DataFrame, pred: str, keys: list[str], core: Column | None = None) -> DataFrame:
    """keys, cluster, n_segments, n_points, mean_x, std_x (population) and frac_core of labelled members (seg, x)."""
    out = [F.count_distinct("seg").alias("n_segments"), F.count("*").alias("n_points"), F.avg("x").alias("mean_x"), F.stddev_pop("x").alias("std_x")]
    if core is not None:
        out.append(F.avg(core.cast("int")).alias("frac_core"))
    return rows.groupBy(*keys, F.col(pred).alias("cluster")).agg(*out)


def composition_flags(clusters: DataFrame, keys: list[str], bound: float = 0.4) -> DataFrame:
    """keys, k, has_transition_cluster and ``label:value`` lists in order of the clusters' means, from ``composition`` with a core."""
    inorder = F.array_sort(F.collect_list(F.struct("mean_x", "cluster", "n_points", "frac_core")))
    rows = clusters.groupBy(*keys).agg(F.count("*").alias("k"), F.max(F.col("frac_core") > bound).alias("has_transition_cluster"), inorder.alias("_c"))  # a row a cluster
    text = lambda show: F.array_join(F.transform("_c", lambda c: F.concat(c["cluster"].cast("string"), F.lit(":"), show(c))), ";")
    return rows.select(
        *keys,
        "k",
        "has_transition_cluster",
        text(lambda c: F.format_string("%.3f", c["mean_x"])).alias("cluster_mean_x"),
        text(lambda c: c["n_points"].cast("string")).alias("cluster_n_points"),
        text(lambda c: F.format_string("%.2f", c["frac_core"])).alias("cluster_frac_core"),
    )


def dependence(rows: DataFrame, a: str, b: str, group: Column, name: str) -> DataFrame:
    """Means, population variances, correlation and the mean difference of magnitudes of two columns, by group."""
    out = []
    for k, c in ((1, a), (2, b)):
        out += [F.avg(c).alias(f"mean_{k}"), F.var_pop(c).alias(f"var_{k}")]
    return rows.groupBy(group.alias(name)).agg(*out, F.corr(a, b).alias("corr"), F.avg(F.abs(F.abs(a) - F.abs(b))).alias("gap"))


def typical_rep(results: DataFrame, keys: list[str], value: str, rep: str = "rep") -> DataFrame:
    """keys, rep: of each group the repetition whose value is nearest the group's mean, the first of those equally near to twelve digits."""
    means = results.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    gap = F.struct(F.round(F.abs(F.col(value) - F.col("_mean")), 12).alias("_d"), rep)
    return results.join(means, keys).where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(gap).alias("_g")).select(*keys, F.col(f"_g.{rep}").alias(rep))


def best_level(results: DataFrame, keys: list[str], score: str = "f1_tau10", error: str = "median_abs_error", level: str = "q", tie: float = 1e-9) -> DataFrame:
    """keys, q: the level of largest score; of those within ``tie`` of it, the one of least error, then the lowest."""
    top = results.groupBy(*keys).agg(F.max(score).alias("_top"))
    tied = results.join(top, keys).where((F.col(score) >= F.col("_top") - tie) & F.col(error).isNotNull())
    return tied.groupBy(*keys).agg(F.min(F.struct(error, level)).alias("_b")).select(*keys, F.col(f"_b.{level}").alias(level))


def rand_with_next(labels: DataFrame, keys: list[str], step: str, point: str, label: str, steps: list[float]) -> DataFrame:
    """keys, step, ari_next: adjusted Rand index of a labelling and the one of the next step of a short grid."""
    grid = F.create_map(*[F.lit(v) for a, b in zip(steps, steps[1:]) for v in (float(a), float(b))])
    a = labels.select(*keys, step, point, F.col(label).alias("_a")).withColumn("_next", F.try_element_at(grid, F.col(step)))
    b = labels.select(*keys, F.col(step).alias("_next"), point, F.col(label).alias("_b"))
    return M.adjusted_rand(a.join(b, [*keys, "_next", point]), "_a", "_b", [*keys, step]).withColumnRenamed("ari", "ari_next")
