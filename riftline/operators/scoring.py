"""Scores of change points, labels, laws and transition counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A


def nearest(points: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Each predicted ``t`` with its nearest ``truth`` (ties to the smaller) and signed offset.

    An as-of join from both sides: the last truth at or before and the first at or
    after, over the union of both in order.
    """
    both = points.select(*keys, "t", F.lit(None).cast("long").alias("c")).union(truth.select(*keys, F.col("truth").alias("t"), F.col("truth").alias("c")))
    order = Window.partitionBy(*keys).orderBy("t", F.col("c").isNull())
    back = F.last("c", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("c", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumn("_b", back).withColumn("_a", ahead).where("c is null and (_a is not null or _b is not null)")
    pick = F.when(F.col("_a").isNull() | (F.col("t") - F.col("_b") <= F.col("_a") - F.col("t")), F.col("_b")).otherwise(F.col("_a"))
    return rows.withColumn("truth", pick).select(*keys, "t", "truth", (F.col("t") - F.col("truth")).alias("offset"))


def offset_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    a = F.abs("offset")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.median(a).alias("median_abs"), F.avg(a).alias("mean_abs"), F.median("offset").alias("median_signed"), F.avg("offset").alias("mean_signed"), F.percentile(a, 0.9).alias("p90_abs")
    )


def match_pairs(predicted, truth, tau: float) -> list[tuple[int, int]]:
    """Index pairs of a largest one-to-one matching within ``tau``, of least total displacement among those.

    On a line some optimal matching doesn't cross, so sorted prefixes suffice.
    """
    p, c = sorted(range(len(predicted)), key=lambda i: predicted[i]), sorted(range(len(truth)), key=lambda j: truth[j])
    best = [[(0, 0.0, 0)] * (len(c) + 1) for _ in range(len(p) + 1)]
    for i in range(1, len(p) + 1):
        for j in range(1, len(c) + 1):
            up, left = best[i - 1][j], best[i][j - 1]
            options = [(up[0], up[1], 1), (left[0], left[1], 2)]
            gap = abs(predicted[p[i - 1]] - truth[c[j - 1]])
            if gap <= tau:
                d = best[i - 1][j - 1]
                options.append((d[0] + 1, d[1] - gap, 3))
            best[i][j] = max(options, key=lambda o: (o[0], o[1]))
    out, i, j = [], len(p), len(c)
    while i and j:
        step = best[i][j][2]
        if step == 3:
            out.append((p[i - 1], c[j - 1]))
        i, j = i - (step in (1, 3)), j - (step in (2, 3))
    return sorted(out)


def count_pairs(predicted, truth, tau: float) -> int:
    """How many pairs a largest one-to-one matching within ``tau`` has, of sorted lists: the first two that can pair may."""
    i = j = pairs = 0
    while i < len(predicted) and j < len(truth):
        gap = predicted[i] - truth[j]
        pairs += abs(gap) <= tau
        i, j = i + (gap <= tau), j + (gap >= -tau)
    return pairs


def strip_ends(points, length: int):
    return [t for t in points if 0 < t < length - 1]


def score(predicted, ramps, tau: float, length: int) -> dict:
    """Precision, recall and F1 of change points against the ends of ramps, one to one."""
    truth = sorted(t for ramp in ramps for t in ramp)
    if not truth:
        raise ValueError("no true change points")
    inner = strip_ends(predicted, length)
    hits = len(match_pairs(inner, truth, tau))
    precision, recall = (hits / len(inner) if inner else 0.0), hits / len(truth)
    f1 = 2 * precision * recall / (precision + recall) if hits else 0.0
    return {"n_true": len(truth), "n_predicted": len(inner), "n_matched": hits, "precision": precision, "recall": recall, "f1": f1}


def tolerance_curve(points: DataFrame, truth: DataFrame, taus: list[int], keys: list[str]) -> DataFrame:
    """keys, tau, n_predicted, n_true, n_matched, precision, recall, f1. One group holds a series' change points, not its points."""
    kind = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def kernel(key, left, right):
        import pandas as pd

        p, c = sorted(left["t"]), sorted(right["truth"])
        rows = []
        for tau in taus:
            hits = count_pairs(p, c, tau)
            precision, recall = (hits / len(p) if p else 0.0), (hits / len(c) if c else 0.0)
            rows.append((*key, tau, len(p), len(c), hits, precision, recall, 2 * precision * recall / (precision + recall) if hits else 0.0))
        return pd.DataFrame(rows, columns=[*keys, "tau", "n_predicted", "n_true", "n_matched", "precision", "recall", "f1"])

    # both sides may come from one table: under names of their own they stay apart
    points, truth = points.select(*[F.col(k).alias(k) for k in keys], "t"), truth.select(*[F.col(k).alias(k) for k in keys], "truth")
    return points.groupBy(*keys).cogroup(truth.groupBy(*keys)).applyInPandas(kernel, f"{kind}, tau long, n_predicted long, n_true long, n_matched long, precision double, recall double, f1 double")


def near_hits(points: DataFrame, truth: DataFrame, tau: int, keys: list[str]) -> DataFrame:
    """Share of predictions with some truth less than ``tau`` away, and of truths found so; not one to one."""
    hit = F.when(F.abs("offset") < tau, 1).otherwise(0)
    p = nearest(points, truth, keys).groupBy(*keys).agg(F.avg(hit).alias("precision"))
    r = nearest(truth.select(*keys, F.col("truth").alias("t")), points.select(*keys, F.col("t").alias("truth")), keys)
    return p.join(r.groupBy(*keys).agg(F.avg(hit).alias("recall")), keys, "full")


def contingency(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, a, b).agg(F.count("*").alias("n"))


def _margins(table: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    return table.withColumns(
        {"na": F.sum("n").over(Window.partitionBy(*keys, a)), "nb": F.sum("n").over(Window.partitionBy(*keys, b)), "total": F.sum("n").over(Window.partitionBy(*keys or [F.lit(0)]))}
    )


def v_measure(rows: DataFrame, truth: str, pred: str, keys: list[str]) -> DataFrame:
    """Homogeneity, completeness and their harmonic mean; null for fewer than two true classes. Works on counts only."""
    m = _margins(contingency(rows, truth, pred, keys), truth, pred, keys)
    n, na, nb, total = (F.col(c).cast("double") for c in ("n", "na", "nb", "total"))
    out = m.groupBy(*keys).agg(
        (-F.sum(n / total * F.ln(na / total))).alias("hc"),
        (-F.sum(n / total * F.ln(nb / total))).alias("hk"),
        (-F.sum(n / total * F.ln(n / nb))).alias("hck"),
        (-F.sum(n / total * F.ln(n / na))).alias("hkc"),
        F.count_distinct(truth).alias("classes"),
    )
    h = F.when(F.col("hc") == 0, 1.0).otherwise(1 - F.col("hck") / F.col("hc"))
    c = F.when(F.col("hk") == 0, 1.0).otherwise(1 - F.col("hkc") / F.col("hk"))
    out = out.select(*keys, F.when(F.col("classes") >= 2, h).alias("homogeneity"), F.when(F.col("classes") >= 2, c).alias("completeness"))
    both = F.col("homogeneity") + F.col("completeness")
    return out.withColumn("v", F.when(both == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / both))


def adjusted_rand(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    table = contingency(rows, a, b, keys)
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = table.groupBy(*keys).agg(pairs("n").alias("s"), F.sum("n").alias("total"))
    left = table.groupBy(*keys, a).agg(F.sum("n").alias("m")).groupBy(*keys).agg(pairs("m").alias("sa"))
    right = table.groupBy(*keys, b).agg(F.sum("n").alias("m")).groupBy(*keys).agg(pairs("m").alias("sb"))
    out = cells.join(left, keys).join(right, keys) if keys else cells.crossJoin(left).crossJoin(right)  # single rows
    expected = F.col("sa") * F.col("sb") / (F.col("total") * (F.col("total") - 1) / 2)
    most = (F.col("sa") + F.col("sb")) / 2
    return out.select(*keys, F.when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"))


def laws(rows: DataFrame, label: str, keys: list[str], levels: int = 512, least: int = 10) -> DataFrame:
    """keys, label, mass, profile of each label with ``least`` points; mass counts all points."""
    total = rows.groupBy(*keys).agg(F.count("*").alias("_total"))
    out = rows.groupBy(*keys, label).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list("x")).alias("_v")).where(F.col("_n") >= least)
    return out.join(total, keys).select(*keys, label, (F.col("_n") / F.col("_total")).alias("mass"), A.quantile_profile(F.col("_v"), levels).alias("profile"))


def law_errors(truth_laws: DataFrame, pred_laws: DataFrame, truth: str, pred: str, keys: list[str]) -> DataFrame:
    """Mass-weighted distance of each side's laws to the nearest law of the other: fidelity and coverage."""
    a = truth_laws.select(*keys, truth, F.col("mass").alias("ma"), F.col("profile").alias("pa"))
    b = pred_laws.select(*keys, pred, F.col("mass").alias("mb"), F.col("profile").alias("pb"))
    d = a.join(b, keys).withColumn("d", F.sqrt(A.squared_gap(F.col("pa"), F.col("pb")) / F.size("pa"))).drop("pa", "pb")
    side = lambda label, mass, name: d.groupBy(*keys, label, mass).agg(F.min("d").alias("d")).groupBy(*keys).agg((F.sum(F.col(mass) * F.col("d")) / F.sum(mass)).alias(name))
    return side(pred, "mb", "fidelity").join(side(truth, "ma", "coverage"), keys)


def lag_counts(rows: DataFrame, label: str, lag: int, keys: list[str], order: str = "t") -> DataFrame:
    """keys, from_state, to_state, n of labels ``lag`` steps apart."""
    to = F.lead(label, lag).over(Window.partitionBy(*keys).orderBy(order))
    pairs = rows.withColumn("to_state", to).where("to_state is not null")
    return pairs.groupBy(*keys, F.col(label).alias("from_state"), "to_state").agg(F.count("*").alias("n"))


def vamp2(counts: DataFrame, keys: list[str]) -> DataFrame:
    """VAMP-2 of sparse transition counts, without the trivial singular value: sum of K_ij^2 - 1."""
    m = _margins(counts, "from_state", "to_state", keys)
    k2 = F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))
    return m.groupBy(*keys).agg((F.sum(k2) - 1).alias("vamp2"))
