"""Every registered query of the analytics operators with its SQL.

Cutoffs and statistics are rounded to nine digits before they are compared and
results to six, so that engines that add in another order agree.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distances as D
from ..operators import generators as G
from ..operators import nulls as N
from ..operators import pipelines as L
from ..operators import reports as R
from ..operators import scoring as M
from ..operators import segments as S
from ..operators import thresholds as T
from ..operators import windows as W
from ..operators.pipelines import AUTO_REPLICATES, REPLICATES
from ..sources import series as src
from ..staging import staged
from . import sqltext as Q

WIDTH, LEVEL = 25, 0.75
LEVELS = [0.5, 0.75, 0.95]
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def rounded(df, *names, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in names})


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stat_of(spark, sf_dir, w=WIDTH):
    return W.metric_derivative(src.events(spark, sf_dir), w)


def stat_table(spark, sf_dir, w=WIDTH):
    """The statistic, written once: cutoffs, runs and ends read it again."""
    return staged(stat_of(spark, sf_dir, w), "statistic")


def cut_points(spark, sf_dir, levels, rule="gradient"):
    stat = stat_table(spark, sf_dir)
    return T.change_points(stat, T.quantile_cutoffs(stat, levels), rule)


def cut_segments(spark, sf_dir, append_end=False, level=LEVEL):
    """The series and its segments, both from one written table."""
    stat = stat_table(spark, sf_dir)
    points = T.change_points(stat, T.quantile_cutoffs(stat, [level]))
    return stat.select("series_id", "t", "x", "n"), T.segments(points, stat, append_end)


# --- windowed statistics ------------------------------------------------------


@query("metric_derivative", f"WITH {Q.SER}, {Q.stat(25)} SELECT series_id, t, round(g, 6) AS g FROM stat")
def _(spark, sf_dir):
    return rounded(stat_of(spark, sf_dir).select("series_id", "t", "g"), "g")


@query("metric_derivative_w100", f"WITH {Q.SER}, {Q.stat(100)} SELECT series_id, t, round(g, 6) AS g FROM stat")
def _(spark, sf_dir):
    return rounded(stat_of(spark, sf_dir, 100).select("series_id", "t", "g"), "g")


@query(
    "mean_shift_statistic",
    f"""WITH {Q.SER} SELECT series_id, t, CASE WHEN t >= 25 AND t < n - 25 THEN round(abs(
       avg(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING)
     - avg(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING)), 6) ELSE 0.0::DOUBLE END AS g FROM ser""",
)
def _(spark, sf_dir):
    return rounded(W.statistic("mean", src.events(spark, sf_dir), WIDTH).select("series_id", "t", "g"), "g")


@query("statistic_gradient", f"WITH {Q.SER}, {Q.stat(25)}, {Q.GRAD} SELECT series_id, t, round(grad, 6) AS grad FROM grad")
def _(spark, sf_dir):
    return rounded(W.gradient(stat_of(spark, sf_dir)).select("series_id", "t", "grad"), "grad")


@query(
    "rolling_mean_centered",
    f"""WITH {Q.SER} SELECT series_id, t, round(avg(x) OVER f5, 6) AS mean5, CASE WHEN count(x) OVER f9 >= 7 THEN round(avg(x) OVER f9, 6) END AS mean9
    FROM ser WINDOW f5 AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
                    f9 AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""",
)
def _(spark, sf_dir):
    rows = W.rolling_mean(src.events(spark, sf_dir), 5, 1, out="mean5")
    return rounded(W.rolling_mean(rows, 9, 7, out="mean9").select("series_id", "t", "mean5", "mean9"), "mean5", "mean9")


@query(
    "cutoff_obs_quantile",
    f"""WITH {Q.SER}, {Q.stat(25)}, {Q.cuts(LEVELS)} SELECT stat.series_id, q, round(avg(CAST(g <= cutoff AS INTEGER)), 6) AS obs_quantile
    FROM stat JOIN cut ON stat.series_id = cut.series_id WHERE t >= 25 AND t < n - 25 GROUP BY ALL""",
)
def _(spark, sf_dir):
    stat = stat_table(spark, sf_dir)
    return rounded(W.observed_quantile(stat, T.quantile_cutoffs(stat, LEVELS), WIDTH), "obs_quantile")


_PSER = Q.SER.replace("value AS x", "(extract('hour' FROM ts) * 60 + extract('minute' FROM ts)) / 1440.0::DOUBLE AS x")


@query(
    "periodic_derivative",
    f"""WITH {_PSER}, w AS (
      SELECT series_id, t, n, list_sort(list(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) AS a,
             list_sort(list(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) AS b FROM ser
    ), e AS (SELECT *, list_concat(list_concat(list_transform(b, lambda v: v - 1), b), list_transform(b, lambda v: v + 1)) AS bb FROM w)
    SELECT series_id, t, CASE WHEN t >= 8 AND t < n - 8 THEN round(round(sqrt(list_min(list_transform(range(17), lambda k:
      list_sum(list_transform(list_zip(a, bb[k + 1 : k + 8]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 8))), 9), 6) ELSE 0.0::DOUBLE END AS g FROM e""",
)
def _(spark, sf_dir):
    day = (F.hour("ts") * 60 + F.minute("ts")) / 1440.0
    table = read(spark, sf_dir, "events").withColumn("day", day)
    series = src.from_table(table, F.col("event_type"), ["ts", "event_id"], F.col("day"))
    return rounded(W.metric_derivative(series, 8, periodic=True).select("series_id", "t", "g"), "g")


@query("sinkhorn_derivative")
def _(spark, sf_dir):
    flip = G.correlation_flip(spark)
    series = flip.select(F.lit("flip").alias("series_id"), "t", F.array("x1", "x2").alias("x"), F.lit(2000).cast("long").alias("n"))
    return W.entropic_derivative(series, 50)


# --- cutoffs, runs, change points ---------------------------------------------


@query("quantile_cutoffs", f"WITH {Q.SER}, {Q.stat(25)}, {Q.cuts(LEVELS)} SELECT series_id, q, round(cutoff, 6) AS cutoff FROM cut")
def _(spark, sf_dir):
    return rounded(T.quantile_cutoffs(stat_of(spark, sf_dir), LEVELS), "cutoff")


@query("runs", f"WITH {Q.points(25, LEVELS)} SELECT DISTINCT series_id, q, run AS start, run_end AS \"end\" FROM cand")
def _(spark, sf_dir):
    stat = stat_table(spark, sf_dir)
    return T.find_runs(stat, T.quantile_cutoffs(stat, LEVELS))


for _rule in ("gradient", "run_edge", "half_max", "peak"):
    query(f"cps_{_rule}", f"WITH {Q.points(25, LEVELS, _rule)} SELECT * FROM cps")(lambda spark, sf_dir, rule=_rule: cut_points(spark, sf_dir, LEVELS, rule))


@query(
    "segment_counts",
    f"WITH {Q.points(25, LEVELS)} SELECT series_id, q, count(*) AS n_segments FROM cps GROUP BY series_id, q",
)
def _(spark, sf_dir):
    stat = stat_table(spark, sf_dir)
    points = T.change_points(stat, T.quantile_cutoffs(stat, LEVELS))
    return T.segments(points, stat, append_end=True).groupBy("series_id", "q").agg(F.count("*").alias("n_segments"))


# --- null distributions ---------------------------------------------------------

_PERM = f"""{Q.SER}, rep AS (SELECT *, unnest(range(199)) AS rep FROM ser), perm AS (
  SELECT series_id, rep, row_number() OVER (PARTITION BY series_id, rep ORDER BY md5('0-' || rep || '-' || t), t) - 1 AS t, x, n FROM rep),
{Q.stat(25, "perm", "series_id, rep", "nul")}, vn AS (SELECT * FROM nul WHERE (t >= 25 AND t < n - 25) OR n <= 50)"""


@query("perm_null_cutoff", f"WITH {_PERM} SELECT series_id, 0.5::DOUBLE AS q, round(quantile_cont(g, 0.5), 6) AS cutoff FROM vn GROUP BY series_id")
def _(spark, sf_dir):
    out = N.null_cutoff(src.events(spark, sf_dir), WIDTH, 0.5, "shuffle", REPLICATES)
    return rounded(out, "cutoff").select("series_id", "q", "cutoff")


@query(
    "perm_null_max_cutoff",
    f"WITH {_PERM}, m AS (SELECT series_id, rep, max(g) AS g FROM vn GROUP BY series_id, rep) SELECT series_id, 0.5::DOUBLE AS q, round(quantile_cont(g, 0.5), 6) AS cutoff FROM m GROUP BY series_id",
)
def _(spark, sf_dir):
    out = N.null_max_cutoff(src.events(spark, sf_dir), WIDTH, 0.5, "shuffle", REPLICATES)
    return rounded(out, "cutoff").select("series_id", "q", "cutoff")


def _block_sql(scheme: str) -> str:
    room = "n" if scheme == "circular" else "n - len + 1"
    return f"""WITH {Q.SER}, sz AS (SELECT series_id, max(n) AS n, greatest(1, least(10, max(n))) AS len FROM ser GROUP BY series_id),
    blk AS (SELECT *, unnest(range(ceil(n / len)::BIGINT)) AS block FROM (SELECT *, unnest(range(30)) AS rep FROM sz)),
    at AS (SELECT *, {Q.uniform("'0-' || rep || '-' || block", f"({room})")} AS start FROM blk),
    pl AS (SELECT series_id, rep, n, block * len + k AS place, (start + k) % n AS t FROM (SELECT *, unnest(range(len)) AS k FROM at)),
    boot AS (SELECT pl.series_id, rep, place AS t, x, pl.n FROM pl JOIN ser ON pl.series_id = ser.series_id AND pl.t = ser.t WHERE place < pl.n),
    {Q.stat(25, "boot", "series_id, rep", "nul")}
    SELECT series_id, 0.5::DOUBLE AS q, round(quantile_cont(g, 0.5), 6) AS cutoff FROM nul WHERE (t >= 25 AND t < n - 25) OR n <= 50 GROUP BY series_id""".replace("at AS (", "placed AS (").replace("FROM at)", "FROM placed)")


for _scheme in ("circular", "moving"):

    @query(f"block_null_cutoff_{_scheme}", _block_sql(_scheme))
    def _(spark, sf_dir, scheme=_scheme):
        out = N.null_cutoff(src.events(spark, sf_dir), WIDTH, 0.5, scheme, AUTO_REPLICATES, 10)
        return rounded(out, "cutoff").select("series_id", "q", "cutoff")


@query(
    "acf",
    f"""WITH {Q.SER}, c AS (SELECT series_id, t, x - avg(x) OVER (PARTITION BY series_id) AS c FROM ser),
    s AS (SELECT a.series_id, b.t - a.t AS lag, sum(a.c * b.c) AS s FROM c a JOIN c b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + 400 GROUP BY ALL)
    SELECT series_id, lag, round(s / max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY series_id), 6) AS rho FROM s""",
)
def _(spark, sf_dir):
    return rounded(N.autocorrelation(src.events(spark, sf_dir)), "rho")


@query("auto_block_length")
def _(spark, sf_dir):
    series, segs = cut_segments(spark, sf_dir, append_end=True, level=0.95)
    return N.auto_block_length(series, segs, WIDTH)


@query("three_rules")
def _(spark, sf_dir):
    """Change points by a fixed quantile, a permutation null and a block null of estimated length, from one statistic."""
    return L.by_rules(stat_table(spark, sf_dir), WIDTH, LEVEL, replicates=REPLICATES)


# --- segments -------------------------------------------------------------------


@query("segments", f'WITH {Q.segs(25, LEVEL)} SELECT series_id, q, seg, start, end_ AS "end" FROM seg')
def _(spark, sf_dir):
    return cut_segments(spark, sf_dir)[1]


@query(
    "segment_stats",
    f'WITH {Q.segs(25, LEVEL, True)} SELECT series_id, q, seg, start, end_ AS "end", CAST(count(*) AS BIGINT) AS length, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM mem GROUP BY ALL',
)
def _(spark, sf_dir):
    return rounded(S.segment_stats(*cut_segments(spark, sf_dir, True)), "mean", "std")


for _mode, _cut in (("library", 1), ("experiment", 0)):

    @query(
        f"point_labels_{_mode}",
        f"""WITH {Q.segs(25, LEVEL, _mode == "experiment")} SELECT ser.series_id, 0.75::DOUBLE AS q, ser.t, coalesce(CAST(seg.seg % 3 AS BIGINT), 0) AS label
        FROM ser LEFT JOIN seg ON ser.series_id = seg.series_id AND ser.t >= start AND ser.t < end_ - {_cut}""",
    )
    def _(spark, sf_dir, mode=_mode):
        series, segs = cut_segments(spark, sf_dir, mode == "experiment")
        return S.point_labels(series, segs, F.col("seg") % 3, mode)


def _samples(spark, sf_dir):
    """Sorted values of each event type and day of the month: samples of unequal sizes."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.lit(0.0).alias("q"), (F.dayofmonth("ts") - 1).cast("long").alias("seg"), F.col("value").alias("x"))
    return rows.groupBy("series_id", "q", "seg").agg(F.array_sort(F.collect_list("x")).alias("v"))


_SAMPLES = """sm AS (SELECT event_type AS series_id, 0.0::DOUBLE AS q, CAST(extract('day' FROM ts) - 1 AS BIGINT) AS seg, list_sort(list(value)) AS v FROM events GROUP BY ALL)"""


@query(
    "segment_w2_exact",
    f"""WITH {_SAMPLES}, r AS (SELECT series_id, seg, len(v) AS n, unnest(v) AS x, unnest(range(len(v))) AS k FROM sm)
    SELECT a.series_id, 0.0::DOUBLE AS q, a.seg AS i, b.seg AS j, round(sqrt(sum((a.x - b.x) * (a.x - b.x) * (least((a.k + 1) * b.n, (b.k + 1) * a.n) - greatest(a.k * b.n, b.k * a.n))) / max(a.n * b.n)), 6) AS d
    FROM r a JOIN r b ON a.series_id = b.series_id AND a.seg <= b.seg AND a.k * b.n < (b.k + 1) * a.n AND b.k * a.n < (a.k + 1) * b.n
    GROUP BY a.series_id, a.seg, b.seg""",
)
def _(spark, sf_dir):
    rows = S.pairs(_samples(spark, sf_dir))
    return rounded(rows.select("series_id", "q", "i", "j", S.exact_w2(F.col("a"), F.col("b")).alias("d")), "d")


_PROFILES = f"{_SAMPLES}, pr AS (SELECT series_id, q, seg, {Q.profile('v', 512)} AS p FROM sm), pd AS (SELECT a.series_id, a.q, a.seg AS i, b.seg AS j, CASE WHEN a.seg = b.seg THEN 0.0::DOUBLE ELSE sqrt({Q.gap('a.p', 'b.p')} / 512) END AS d FROM pr a JOIN pr b ON a.series_id = b.series_id AND a.seg <= b.seg)"


def _profile_distances(spark, sf_dir):
    return S.sample_profile_distances(_samples(spark, sf_dir))


@query("quantile_profile_w2", f"WITH {_PROFILES} SELECT series_id, q, i, j, round(d, 6) AS d FROM pd")
def _(spark, sf_dir):
    return rounded(_profile_distances(spark, sf_dir), "d")


@query(
    "similarity_median_heuristic",
    f"""WITH {_PROFILES}, sg AS (SELECT series_id, greatest(median(d * d) / 2, 1e-12) AS sigma FROM pd WHERE i < j GROUP BY series_id)
    SELECT pd.series_id, q, i, j, round(exp(-d * d / (2 * sigma)), 6) AS similarity FROM pd JOIN sg ON pd.series_id = sg.series_id""",
)
def _(spark, sf_dir):
    d = _profile_distances(spark, sf_dir)
    out = d.join(S.median_sigma(d), ["series_id", "q"])
    return rounded(out.select("series_id", "q", "i", "j", S.similarity(d, F.col("sigma")).alias("similarity")), "similarity")


@query(
    "laplace_w2",
    """WITH l AS (SELECT event_type, avg(value) AS mu, stddev_pop(value) / sqrt(2.0::DOUBLE) AS b FROM events GROUP BY event_type)
    SELECT x.event_type AS a, y.event_type AS b, round(sqrt((x.mu - y.mu) * (x.mu - y.mu) + 2 * (x.b - y.b) * (x.b - y.b)), 6) AS w2 FROM l x JOIN l y ON x.event_type < y.event_type""",
)
def _(spark, sf_dir):
    laws = read(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mu"), (F.stddev_pop("value") / F.lit(2.0**0.5)).alias("b"))
    x, y = laws.select(F.col("event_type").alias("a"), F.col("mu").alias("m1"), F.col("b").alias("b1")), laws.select(F.col("event_type").alias("b"), F.col("mu").alias("m2"), F.col("b").alias("b2"))
    return rounded(x.join(y, F.col("a") < F.col("b")).select("a", "b", D.laplace_w2(F.col("m1"), F.col("b1"), F.col("m2"), F.col("b2")).alias("w2")), "w2")


@query(
    "cluster_composition",
    f"""WITH {Q.segs(25, LEVEL, True)} SELECT series_id, seg % 3 AS cluster, count(DISTINCT seg) AS n_segments, count(*) AS n_points, round(avg(x), 6) AS mean_x,
    round(stddev_pop(x), 6) AS std_x, round(avg(CAST(abs(x - 50) < 25 AS INTEGER)), 6) AS frac_core FROM mem GROUP BY series_id, seg % 3""",
)
def _(spark, sf_dir):
    series, segs = cut_segments(spark, sf_dir, True)
    rows = S.members(series, segs).groupBy("series_id", (F.col("seg") % 3).alias("cluster"))
    out = rows.agg(F.count_distinct("seg").alias("n_segments"), F.count("*").alias("n_points"), F.avg("x").alias("mean_x"), F.stddev_pop("x").alias("std_x"), F.avg((F.abs(F.col("x") - 50) < 25).cast("int")).alias("frac_core"))
    return rounded(out, "mean_x", "std_x", "frac_core")


# --- scores ---------------------------------------------------------------------

_TRUTH = "truth AS (SELECT DISTINCT series_id, CAST(100 * (t // 100) + 50 AS BIGINT) AS truth FROM ser)"


def _truth(series):
    return series.select("series_id", (100 * F.floor(F.col("t") / 100) + 50).cast("long").alias("truth")).distinct()


_NEAR = f"""WITH {Q.points(25, [LEVEL], "peak")}, {_TRUTH}, near AS (
  SELECT c.series_id, c.t, arg_min(truth, (abs(c.t - truth), truth)) AS truth FROM cps c JOIN truth ON c.series_id = truth.series_id GROUP BY c.series_id, c.t),
off AS (SELECT series_id, t, truth, t - truth AS o FROM near)"""


@query(
    "nearest_offset_stats",
    f"""{_NEAR} SELECT series_id, count(*) AS n, median(abs(o)) AS median_abs, round(avg(abs(o)), 6) AS mean_abs, median(o) AS median_signed, round(avg(o), 6) AS mean_signed,
    round(quantile_cont(abs(o), 0.9), 6) AS p90_abs FROM off GROUP BY series_id""",
)
def _(spark, sf_dir):
    points = cut_points(spark, sf_dir, [LEVEL], "peak").select("series_id", "t")
    rows = M.nearest(points, _truth(src.events(spark, sf_dir)), ["series_id"])
    return rounded(M.offset_stats(rows, ["series_id"]), "mean_abs", "mean_signed", "p90_abs")


@query("nearest_truth", f"{_NEAR} SELECT series_id, t, truth, o AS offset FROM off".replace("AS offset", 'AS "offset"'))
def _(spark, sf_dir):
    return M.nearest(cut_points(spark, sf_dir, [LEVEL], "peak").select("series_id", "t"), _truth(src.events(spark, sf_dir)), ["series_id"])


@query(
    "tolerance_hits",
    f"""WITH {Q.points(25, [LEVEL], "peak")}, {_TRUTH},
    p AS (SELECT c.series_id, avg(CAST(EXISTS (SELECT 1 FROM truth x WHERE x.series_id = c.series_id AND abs(x.truth - c.t) < 10) AS INTEGER)) AS p FROM cps c GROUP BY c.series_id),
    r AS (SELECT x.series_id, avg(CAST(EXISTS (SELECT 1 FROM cps c WHERE x.series_id = c.series_id AND abs(x.truth - c.t) < 10) AS INTEGER)) AS r FROM truth x GROUP BY x.series_id)
    SELECT series_id, round(p, 6) AS "precision", round(r, 6) AS recall FROM p FULL JOIN r USING (series_id)""",
)
def _(spark, sf_dir):
    points = cut_points(spark, sf_dir, [LEVEL], "peak").select("series_id", "t")
    return rounded(M.near_hits(points, _truth(src.events(spark, sf_dir)), 10, ["series_id"]), "precision", "recall")


@query("tolerance_curve", Q.curve(Q.points(25, [LEVEL], "peak") + ", pts AS (SELECT series_id, t FROM cps)", _TRUTH, [0, 5, 10, 25, 50]))
def _(spark, sf_dir):
    points = cut_points(spark, sf_dir, [LEVEL], "peak").select("series_id", "t")
    return rounded(M.tolerance_curve(points, _truth(src.events(spark, sf_dir)), [0, 5, 10, 25, 50], ["series_id"]), "precision", "recall", "f1")


@query(
    "v_measure",
    """WITH c AS (SELECT lang, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS na, sum(count(*)) OVER (PARTITION BY source) AS nb, sum(count(*)) OVER () AS total FROM documents GROUP BY lang, source),
    e AS (SELECT -sum(n / total * ln(na / total)) AS hc, -sum(n / total * ln(nb / total)) AS hk, -sum(n / total * ln(n / nb)) AS hck, -sum(n / total * ln(n / na)) AS hkc FROM (SELECT n::DOUBLE n, na::DOUBLE na, nb::DOUBLE nb, total::DOUBLE total FROM c)),
    s AS (SELECT 1 - hck / hc AS h, 1 - hkc / hk AS c FROM e) SELECT round(h, 6) AS homogeneity, round(c, 6) AS completeness, round(2 * h * c / (h + c), 6) AS v FROM s""",
)
def _(spark, sf_dir):
    return rounded(M.v_measure(read(spark, sf_dir, "documents"), "lang", "source", []), "homogeneity", "completeness", "v")


@query(
    "adjusted_rand",
    """WITH t AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
    s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS total FROM t), l AS (SELECT sum(m * (m - 1) / 2) AS sa FROM (SELECT sum(n) AS m FROM t GROUP BY a)),
    r AS (SELECT sum(m * (m - 1) / 2) AS sb FROM (SELECT sum(n) AS m FROM t GROUP BY b))
    SELECT round((s - sa * sb / (total * (total - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (total * (total - 1) / 2)), 6) AS ari FROM s, l, r""",
)
def _(spark, sf_dir):
    return rounded(M.adjusted_rand(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", []), "ari")


_LAWS = f"""tl AS (SELECT event_type, count(*)::DOUBLE / sum(count(*)) OVER () AS m, list_sort(list(value)) AS v FROM events GROUP BY event_type HAVING count(*) >= 10),
pl AS (SELECT user_id % 4 AS u, count(*)::DOUBLE / sum(count(*)) OVER () AS m, list_sort(list(value)) AS v FROM events GROUP BY user_id % 4 HAVING count(*) >= 10),
tp AS (SELECT event_type, m, {Q.profile("v", 512)} AS p FROM tl), pp AS (SELECT u, m, {Q.profile("v", 512)} AS p FROM pl),
dd AS (SELECT event_type, u, tp.m AS ma, pp.m AS mb, sqrt({Q.gap("tp.p", "pp.p")} / 512) AS d FROM tp, pp)"""


@query(
    "distributional_fidelity",
    f"""WITH {_LAWS} SELECT 0 AS k, round((SELECT sum(mb * d) / sum(mb) FROM (SELECT u, mb, min(d) AS d FROM dd GROUP BY u, mb)), 6) AS fidelity,
    round((SELECT sum(ma * d) / sum(ma) FROM (SELECT event_type, ma, min(d) AS d FROM dd GROUP BY event_type, ma)), 6) AS coverage""",
)
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.lit(0).alias("k"), "event_type", (F.col("user_id") % 4).alias("u"), F.col("value").alias("x"))
    return rounded(M.law_errors(M.laws(rows, "event_type", ["k"]), M.laws(rows, "u", ["k"]), "event_type", "u", ["k"]), "fidelity", "coverage")


_LAGS = """lg AS (SELECT conv_id % 3 AS part, role AS from_state, lead(role, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS to_state FROM conversations),
cn AS (SELECT from_state, to_state, count(*) AS n FROM lg WHERE to_state IS NOT NULL GROUP BY ALL)"""


def _role_counts(spark, sf_dir):
    counts = M.lag_counts(read(spark, sf_dir, "conversations"), "role", 1, ["conv_id"], "turn")
    return counts.groupBy("from_state", "to_state").agg(F.sum("n").alias("n"))


@query("lag_counts", f"WITH {_LAGS} SELECT from_state, to_state, n FROM cn")
def _(spark, sf_dir):
    return _role_counts(spark, sf_dir)


_EVENT_LAGS = f"""{Q.SER}, lb AS (SELECT series_id, t, CAST(least(floor(x / 25), 3) AS BIGINT) AS label FROM ser),
lg AS (SELECT series_id, label AS from_state, lead(label, 5) OVER (PARTITION BY series_id ORDER BY t) AS to_state FROM lb),
cn AS (SELECT series_id, from_state, to_state, count(*)::DOUBLE AS n FROM lg WHERE to_state IS NOT NULL GROUP BY ALL),
mg AS (SELECT *, sum(n) OVER (PARTITION BY series_id, from_state) AS na, sum(n) OVER (PARTITION BY series_id, to_state) AS nb FROM cn)"""


@query("vamp2", f"WITH {_EVENT_LAGS} SELECT series_id, round(sum(n * n / (na * nb)) - 1, 6) AS vamp2 FROM mg GROUP BY series_id")
def _(spark, sf_dir):
    rows = src.events(spark, sf_dir).withColumn("label", F.least(F.floor(F.col("x") / 25), F.lit(3)).cast("long"))
    return rounded(M.vamp2(M.lag_counts(rows, "label", 5, ["series_id"]), ["series_id"]), "vamp2")


@query(
    "dependence_report",
    """SELECT l_quantity < 25 AS pre, round(avg(l_discount), 6) AS mean_1, round(var_pop(l_discount), 6) AS var_1, round(avg(l_tax), 6) AS mean_2, round(var_pop(l_tax), 6) AS var_2,
    round(corr(l_discount, l_tax), 6) AS corr, round(avg(abs(abs(l_discount) - abs(l_tax))), 6) AS gap FROM lineitem GROUP BY l_quantity < 25""",
)
def _(spark, sf_dir):
    out = read(spark, sf_dir, "lineitem").groupBy((F.col("l_quantity") < 25).alias("pre")).agg(
        F.avg("l_discount").alias("mean_1"), F.var_pop("l_discount").alias("var_1"), F.avg("l_tax").alias("mean_2"), F.var_pop("l_tax").alias("var_2"),
        F.corr("l_discount", "l_tax").alias("corr"), F.avg(F.abs(F.abs("l_discount") - F.abs("l_tax"))).alias("gap"),
    )
    return rounded(out, "mean_1", "var_1", "mean_2", "var_2", "corr", "gap")
