"""Registered queries of whole pipelines: thresholds, segmentations, clusterings and grids of detections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import distances as D
from ..operators import evaluation as E
from ..operators import generators as G
from ..operators import nulls as N
from ..operators import pipelines as L
from ..operators import reports as R
from ..operators import thresholds as T
from ..operators import windows as W
from ..sources import series as src
from ..staging import staged
from . import sqltext as Q
from .catalog import LEVEL, WIDTH, query, read, rounded, stat_table
from .evaluations import _RAMPS, _ramps

# --- change points -------------------------------------------------------------------


@query("end_to_end_points", f"WITH {Q.points(50, [0.9])} SELECT * FROM cps")
def _(spark, sf_dir):
    return L.find_change_points(src.events(spark, sf_dir), 50, 0.9)


@query("pilot_segments", f'WITH {Q.segs(25, LEVEL, True)} SELECT series_id, q, seg, start, end_ AS "end" FROM seg')
def _(spark, sf_dir):
    return L.pilot_segments(stat_table(spark, sf_dir), LEVEL)


@query("auto_change_points")
def _(spark, sf_dir):
    return L.auto_change_points(src.events(spark, sf_dir), WIDTH, LEVEL)


@query("cutoffs_by_rule")
def _(spark, sf_dir):
    """All cutoff rules of one statistic, with the segments and the observed quantile each gives."""
    stat = stat_table(spark, sf_dir)
    out = None
    for rule in L.CUTOFFS:
        cut = L.cutoffs_by(rule, stat, WIDTH, LEVEL)
        ends = T.segments(T.change_points(stat, cut), stat, append_end=True).groupBy("series_id", "q").agg(F.count("*").alias("n_segments"))
        rows = cut.join(ends, ["series_id", "q"]).join(W.observed_quantile(stat, cut, WIDTH), ["series_id", "q"]).withColumn("rule", F.lit(rule))
        rows = staged(rows, "rule")  # one small plan after another
        out = rows if out is None else out.unionByName(rows)
    return out


@query("block_null_grid")
def _(spark, sf_dir):
    """Cutoff, observed quantile and segments by scheme and block length."""
    stat = stat_table(spark, sf_dir)
    out = None
    for scheme in ("circular", "moving"):
        for length in (1, 5, 50):
            cut = L.cutoffs_by("block", stat, WIDTH, LEVEL, length=length, scheme=scheme)
            ends = T.segments(T.change_points(stat, cut), stat, append_end=True).groupBy("series_id", "q").agg(F.count("*").alias("n_segments"))
            rows = cut.join(ends, ["series_id", "q"]).join(W.observed_quantile(stat, cut, WIDTH), ["series_id", "q"])
            rows = rows.select(F.lit(scheme).alias("scheme"), F.lit(length).alias("block_length"), "series_id", "cutoff", F.col("obs_quantile").alias("cutoff_obs_quantile"), "n_segments")
            rows = staged(rows, "setting")
            out = rows if out is None else out.unionByName(rows)
    return out


# --- clusterings ---------------------------------------------------------------------------

_ORACLE = f"""{_RAMPS}, pt AS (SELECT series_id, start AS t FROM ramps UNION SELECT series_id, stop FROM ramps UNION SELECT DISTINCT series_id, 0 FROM ser UNION SELECT DISTINCT series_id, n FROM ser)"""


@query("oracle_segments", f"""WITH {Q.SER}, {_ORACLE} SELECT series_id, 0.0::DOUBLE AS q, row_number() OVER o - 1 AS seg, CAST(t AS BIGINT) AS start, CAST(lead(t) OVER o AS BIGINT) AS "end" FROM pt WINDOW o AS (PARTITION BY series_id ORDER BY t) QUALIFY lead(t) OVER o IS NOT NULL""")
def _(spark, sf_dir):
    series = src.events(spark, sf_dir)
    return T.segments(L.oracle_points(series, _ramps(series)))


@query("cluster_oracle_segments")
def _(spark, sf_dir):
    series = src.events(spark, sf_dir)
    return L.cluster_changes(series, L.oracle_points(series, _ramps(series)), append_end=False)


def _quality(spark, sf_dir, threshold, replicates=L.AUTO_REPLICATES):
    """V-measure of clustered change-point segments against three states of the values, by series."""
    series = src.events(spark, sf_dir)
    clusters = L.cluster_trajectory(series, WIDTH, LEVEL, threshold, replicates)
    labels = L.labelled_points(series, clusters).drop("q")
    truth = series.select("series_id", "t", "x", F.when(F.col("x") < 33, 0).when(F.col("x") < 66, 1).otherwise(2).alias("truth"))
    return truth.join(labels, ["series_id", "t"])


@query("v_measure_run")
def _(spark, sf_dir):
    out = None
    for threshold in L.THRESHOLDS:
        rows = E.two_targets(_quality(spark, sf_dir, threshold), "truth", "label", ["series_id"]).withColumn("threshold", F.lit(threshold))
        rows = staged(rows, "threshold")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("fidelity_run")
def _(spark, sf_dir):
    return E.both_errors(_quality(spark, sf_dir, "quantile"), "truth", "label", ["series_id"])


# --- grids -----------------------------------------------------------------------------------

_LEVELS = [0.5, 0.75, 0.9, 0.95]
_TAUS = [5, 10, 25]
_INNER = "pts AS (SELECT c.series_id, c.q, c.t FROM cps c JOIN (SELECT series_id, max(n) AS n FROM ser GROUP BY 1) s ON s.series_id = c.series_id AND c.t > 0 AND c.t < n - 1)"
_TRUE = f"{_RAMPS}, truth AS (SELECT series_id, start AS truth FROM ramps UNION ALL SELECT series_id, stop FROM ramps)"


def _grid(spark, sf_dir, **options):
    series = src.events(spark, sf_dir)
    truth = E.true_points(_ramps(series)).select("series_id", "truth")
    out = L.detection_grid(series, truth, taus=_TAUS, **options)
    return rounded(out, "precision", "recall", "f1")


@query("threshold_sweep", Q.curve(f"{Q.points(25, _LEVELS)}, {_INNER}", _TRUE, _TAUS, "series_id, q"))
def _(spark, sf_dir):
    out = _grid(spark, sf_dir, windows=[25], levels=_LEVELS, rules=["gradient"])
    return out.drop("kind", "w", "cutoffs", "rule")


for _rule in ("run_edge", "half_max"):

    @query(f"toy_sweep_{_rule}", Q.curve(f"{Q.points(50, [0.95], _rule)}, {_INNER}", _TRUE, _TAUS, "series_id, q"))
    def _(spark, sf_dir, rule=_rule):
        return _grid(spark, sf_dir, windows=[50], levels=[0.95], rules=[rule]).drop("kind", "w", "cutoffs", "rule")


@query("window_grid")
def _(spark, sf_dir):
    """Every rule at several windows and levels: one statistic a window."""
    return _grid(spark, sf_dir, windows=[10, 25, 50, 100], levels=_LEVELS, rules=["gradient", "run_edge", "half_max"])


@query("variance_sweep_mean", Q.curve(f"{Q.points(25, [LEVEL], 'peak', Q.mean_stat(25))}, {_INNER}", _TRUE, _TAUS, "series_id, q"))
def _(spark, sf_dir):
    return _grid(spark, sf_dir, windows=[25], levels=[LEVEL], rules=["peak"], kinds=["mean"]).drop("kind", "w", "cutoffs", "rule")


@query("resampling_grid")
def _(spark, sf_dir):
    """Fixed and null cutoffs against the same truth."""
    return _grid(spark, sf_dir, windows=[25], levels=[LEVEL], rules=["gradient"], cutoffs=["fixed", "shuffle", "max"])


def _arms(spark):
    """series_id, t, x, n of the three arms of changes, and their true change points."""
    rows = G.variance_arms(spark).withColumnRenamed("kind", "series_id")
    series = rows.withColumn("n", F.lit(5000).cast("long"))
    return series, series.select("series_id").distinct().withColumn("truth", F.explode(F.sequence(F.lit(250).cast("long"), F.lit(4750).cast("long"), F.lit(250).cast("long"))))


@query("variance_sweep")
def _(spark, sf_dir):
    series, truth = _arms(spark)
    return L.detection_grid(series, truth, [25, 50, 100], [0.75, 0.9], ["peak", "gradient"], [5, 10, 25], kinds=["w2", "mean"])


@query("imbalanced_run")
def _(spark, sf_dir):
    """Small and big recall and precision by ratio and cutoff rule, and the recall of as many random points."""
    out = None
    for ratio in (1, 3, 10):
        rows = G.imbalanced(spark, ratio)
        series = rows.select(F.lit(ratio).alias("series_id"), "t", "x", F.lit(6600).cast("long").alias("n"))
        truth = spark.range(1, 33).select(F.lit(ratio).alias("series_id"), (F.col("id") * 200).alias("truth"), F.when((F.col("id") - 1) % 4 < 2, "small").otherwise("big").alias("size"))
        stat = L.statistic_table(series, WIDTH)
        for rule in ("fixed", "shuffle"):
            points = T.change_points(stat, L.cutoffs_by(rule, stat, WIDTH, LEVEL), "peak").select("series_id", "t")
            found = E.recall_by_size(points, truth, 10, ["series_id"])
            counts = points.groupBy("series_id").agg(F.count("*").cast("int").alias("n"))
            found = found.join(counts, "series_id").join(E.chance_recall(counts, truth.drop("size"), 6600, 10, 40, ["series_id"]), "series_id").withColumn("rule", F.lit(rule))
            out = found if out is None else out.unionByName(found)
    return out


def _flip(spark, make, w, reg, iterations=200):
    """t and statistic of each coordinate, both principal axes, and the joint windows of a change in dependence."""
    rows = D.project(make(spark), ["x1", "x2"])
    names = ["x1", "x2", "pc1", "pc2"]
    long = rows.unpivot(["t"], names, "series_id", "x").select("series_id", "t", "x", F.lit(2000).cast("long").alias("n"))
    single = W.metric_derivative(long, w).select("series_id", "t", "g")
    joint = rows.select(F.lit("joint").alias("series_id"), "t", F.array("x1", "x2").alias("x"), F.lit(2000).cast("long").alias("n"))
    return single.unionByName(W.entropic_derivative(joint, w, reg, iterations))


@query("correlation_flip_run")
def _(spark, sf_dir):
    return _flip(spark, G.correlation_flip, 50, 0.05)


@query("copula_flip_run")
def _(spark, sf_dir):
    return _flip(spark, G.copula_flip, 150, 0.03, 50)


@query("proof_of_concept")
def _(spark, sf_dir):
    """The statistic of a series that changes its law once."""
    series = G.two_regimes(spark).select(F.lit("demo").alias("series_id"), "t", "x", F.lit(10_000).cast("long").alias("n"))
    return W.metric_derivative(series, 100)


# --- frames behind figures ---------------------------------------------------------------------


@query(
    "statistic_frame",
    f"""WITH {Q.points(25, [LEVEL])} SELECT g.series_id, g.t, round(g.g, 6) AS g, round(g.grad, 6) AS grad, r.run IS NOT NULL AS in_run, c.t IS NOT NULL AS is_change FROM grad g
    LEFT JOIN (SELECT DISTINCT series_id, t, run FROM cand) r ON r.series_id = g.series_id AND r.t = g.t LEFT JOIN cps c ON c.series_id = g.series_id AND c.t = g.t""",
)
def _(spark, sf_dir):
    """t, statistic, gradient, whether in a kept run, whether a change point."""
    stat = stat_table(spark, sf_dir)
    cut = T.quantile_cutoffs(stat, [LEVEL])
    runs = T.members_of(stat, T.runs_of(stat, cut), cut).select("series_id", "t", F.lit(True).alias("in_run"))
    points = T.change_points(stat, cut).select("series_id", "t", F.lit(True).alias("is_change"))
    out = stat.select("series_id", "t", "g", "grad").join(runs, ["series_id", "t"], "left").join(points, ["series_id", "t"], "left").fillna(False, ["in_run", "is_change"])
    return rounded(out, "g", "grad")


@query(
    "rolling_quality_frame",
    """WITH m AS (SELECT l_linenumber AS noise, l_suppkey % 100 + 1 AS tl, avg(l_discount) AS v FROM lineitem GROUP BY ALL) SELECT noise, tl, round(v, 6) AS v,
    round(CASE WHEN count(v) OVER o >= 3 THEN avg(v) OVER o END, 6) AS rolling FROM m WINDOW o AS (PARTITION BY noise ORDER BY tl ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""",
)
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("series_id"), (F.col("l_suppkey") % 100 + 1).alias("t")).agg(F.avg("l_discount").alias("x"))
    out = W.rolling_mean(rows.withColumn("n", F.lit(100).cast("long")), 9, 3)
    return rounded(out.select(F.col("series_id").alias("noise"), F.col("t").alias("tl"), F.col("x").alias("v"), F.col("mean").alias("rolling")), "v", "rolling")


@query("null_shift_histograms")
def _(spark, sf_dir):
    """Shares of 30 equal bins of the observed statistic, its permutation null and its block null."""
    stat = stat_table(spark, sf_dir)
    series = stat.select("series_id", "t", "x", "n")
    frames = {
        "observed": stat.where(W.inside(WIDTH)).select("series_id", "g"),
        "shuffle": N.null_rows(series, WIDTH, "shuffle", L.AUTO_REPLICATES).select("series_id", "g"),
        "block": N.null_rows(series, WIDTH, "circular", L.AUTO_REPLICATES, 50).select("series_id", "g"),
    }
    out = None
    for name, rows in frames.items():
        rows = rows.withColumn("null", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    bins = R.histogram(out, "g", 0.0, 60.0, 30, ["series_id", "null"])
    total = F.sum("n").over(Window.partitionBy("series_id", "null"))  # a row a bin
    return bins.withColumn("density", F.col("n") / total / 2.0)
