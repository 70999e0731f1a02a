"""Registered queries of projections, ramps, evaluation scores and report tables, with their SQL.

Point sets are the samples above 95; ramps are the places 40 to 60 of each
hundred; result frames for report tables are made from ``lineitem`` alike in
both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import projections as P
from ..operators import scoring as M
from ..operators import tables as B
from ..sources import series as src
from . import sqltext as Q
from .catalog import query, read, rounded

# --- projections -------------------------------------------------------------------


@query("range_slice", f"WITH {Q.SER} SELECT series_id, t - 100 AS t, x, n - 150 AS n FROM ser WHERE t >= 100 AND t < n - 50")
def _(spark, sf_dir):
    return P.range_slice(src.events(spark, sf_dir), 100, -50)


@query("affine_rescale", "SELECT event_id, round((value + 180) / 360.0::DOUBLE, 6) AS turns, round((value + 180) / 360.0::DOUBLE * 360 - 180, 6) AS degrees FROM events")
def _(spark, sf_dir):
    turns = P.rescale(F.col("value"), -180.0, 180.0)
    return rounded(read(spark, sf_dir, "events").select("event_id", turns.alias("turns"), P.unscale(turns, -180.0, 180.0).alias("degrees")), "turns", "degrees")


_CORE = "SELECT event_id, value - 50 AS x, CASE WHEN value - 50 < -10 THEN 'A' WHEN value - 50 > 10 THEN 'B' ELSE 'transition' END AS state FROM events"


@query("without_transitions", f"SELECT event_id, state FROM ({_CORE}) WHERE state <> 'transition'")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", P.core_state(F.col("value") - 50, 10).alias("state"))
    return P.without_transitions(rows, "state", "transition")


@query(
    "predicates",
    "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R') AND abs(l_discount - 0.05) <= 1e-8 + 1e-5 * 0.05",
)
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R") & P.close_to(F.col("l_discount"), 0.05))
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag")


@query("drop_nulls", "SELECT p_partkey, p_brand AS brand FROM part WHERE p_size > 25 AND p_brand IS NOT NULL")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("brand"))
    return rows.dropna(subset=["brand"])


@query(
    "window_settings",
    """SELECT s_suppkey, setting, CAST(CASE WHEN setting = 'oracle' THEN greatest(2 * s_suppkey, 2) ELSE CAST(substr(setting, 2) AS BIGINT) END AS INTEGER) AS w,
    CAST(5000 + 19 * s_suppkey AS BIGINT) AS length, round(1 - 19 * s_suppkey / (5000.0::DOUBLE + 19 * s_suppkey), 6) AS q_star FROM supplier, (VALUES ('oracle'), ('w25'), ('w100')) v(setting)""",
)
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(*[F.lit(s) for s in ("oracle", "w25", "w100")])).alias("setting"))
    n = F.col("s_suppkey")
    out = rows.select("s_suppkey", "setting", P.window_of(F.col("setting"), n).alias("w"), P.expected_length(n).cast("long").alias("length"), P.expected_quantile(n).alias("q_star"))
    return rounded(out, "q_star")


# --- ramps ---------------------------------------------------------------------------

_RAMPS = "ramps AS (SELECT DISTINCT series_id, CAST(t // 100 AS BIGINT) AS ramp, CAST(100 * (t // 100) + 40 AS BIGINT) AS start, CAST(100 * (t // 100) + 60 AS BIGINT) AS stop FROM ser WHERE 100 * (t // 100) + 60 < n)"
_HOT = "hot AS (SELECT series_id, t FROM ser WHERE x > 95)"


def _ramps(series):
    k = F.floor(F.col("t") / 100)
    rows = series.select("series_id", "n", k.cast("long").alias("ramp")).distinct()
    return rows.select("series_id", "ramp", (100 * F.col("ramp") + 40).alias("start"), (100 * F.col("ramp") + 60).alias("end"), "n").where("end < n").drop("n")


def _hot(series):
    return series.where("x > 95").select("series_id", "t")


@query("inner_points", f"WITH {Q.SER}, {_HOT} SELECT hot.series_id, hot.t FROM hot JOIN (SELECT series_id, max(n) AS n FROM ser GROUP BY 1) s ON s.series_id = hot.series_id AND t > 0 AND t < n - 1")
def _(spark, sf_dir):
    series = src.events(spark, sf_dir)
    return P.inner_points(_hot(series), series.groupBy("series_id").agg(F.max("n").alias("n")))


@query(
    "ramp_labels",
    f"""WITH {Q.SER}, {_RAMPS} SELECT ser.series_id, ser.t, CAST(CASE WHEN EXISTS (SELECT 1 FROM ramps r WHERE r.series_id = ser.series_id AND ser.t >= r.start AND ser.t < r.stop) THEN 1
    ELSE (SELECT count(*) FROM ramps r WHERE r.series_id = ser.series_id AND r.stop <= ser.t) % 2 * 2 END AS INTEGER) AS state FROM ser""",
)
def _(spark, sf_dir):
    series = src.events(spark, sf_dir)
    return P.ramp_labels(series.select("series_id", "t"), _ramps(series))


@query(
    "ramp_first_hits",
    f"WITH {Q.SER}, {_RAMPS}, {_HOT} SELECT r.series_id, r.ramp, min(h.t) AS t FROM ramps r JOIN hot h ON h.series_id = r.series_id AND h.t > r.start AND h.t < r.stop GROUP BY ALL",
)
def _(spark, sf_dir):
    series = src.events(spark, sf_dir)
    return P.first_hits(_hot(series), _ramps(series))


@query(
    "crop_windows",
    f"""WITH {Q.SER}, {_RAMPS}, w AS (SELECT *, coalesce(lag(stop) OVER o, 0) AS before, lead(stop, 2) OVER o AS fin, lead(start, 3) OVER o AS later FROM ramps WINDOW o AS (PARTITION BY series_id ORDER BY start))
    SELECT series_id, ramp, CAST(start - least(40, (start - before) // 3) AS BIGINT) AS low, CAST(fin + least(40, (coalesce(later, fin + 80) - fin) // 3) AS BIGINT) AS high FROM w WHERE fin IS NOT NULL""",
)
def _(spark, sf_dir):
    return P.crop_windows(_ramps(src.events(spark, sf_dir)), F.lit(20))


# --- scores of points ------------------------------------------------------------------


@query("true_points", f"WITH {Q.SER}, {_RAMPS} SELECT series_id, start AS truth, 'start' AS side FROM ramps UNION ALL SELECT series_id, stop, 'end' FROM ramps")
def _(spark, sf_dir):
    return E.true_points(_ramps(src.events(spark, sf_dir)))


@query(
    "localisation",
    f"""WITH {Q.SER}, {_RAMPS}, {_HOT}, ends AS (SELECT series_id, start AS c, 1 AS way FROM ramps UNION ALL SELECT series_id, stop, -1 FROM ramps),
    near AS (SELECT h.series_id, h.t, arg_min(c, (abs(h.t - c), c)) AS c, arg_min(way, (abs(h.t - c), c)) AS way FROM hot h JOIN ends e ON h.series_id = e.series_id GROUP BY h.series_id, h.t)
    SELECT series_id, count(*) AS n, median(abs(t - c)) AS median_abs, round(avg(abs(t - c)), 6) AS mean_abs, median((t - c) * way) AS median_signed, round(avg((t - c) * way), 6) AS mean_signed,
    round(quantile_cont(abs(t - c), 0.9), 6) AS p90_abs FROM near GROUP BY series_id""",
)
def _(spark, sf_dir):
    series = src.events(spark, sf_dir)
    return rounded(E.localisation(_hot(series), _ramps(series), ["series_id"]), "mean_abs", "mean_signed", "p90_abs")


_SCORES = """m::DOUBLE / np AS p, m::DOUBLE / nc AS r"""
_ENDS = f"{_RAMPS}, {_HOT}, ends AS (SELECT series_id, start AS c FROM ramps UNION ALL SELECT series_id, stop FROM ramps)"
_LISTS = """lists AS (SELECT a.series_id, tau, p, c FROM (SELECT series_id, list(t ORDER BY t) AS p FROM hot GROUP BY 1) a
  JOIN (SELECT series_id, list(c ORDER BY c) AS c FROM ends GROUP BY 1) b ON a.series_id = b.series_id, taus)"""


@query(
    "pair_scores",
    f"""WITH RECURSIVE {Q.SER}, {_ENDS}, taus AS (SELECT 10 AS tau), {_LISTS}, {Q.greedy("lists", "series_id")}, s AS (SELECT series_id, {_SCORES} FROM hits)
    SELECT series_id, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s""",
)
def _(spark, sf_dir):
    series = src.events(spark, sf_dir)
    out = E.pair_scores(_hot(series), E.true_points(_ramps(series)).drop("side"), 10, ["series_id"])
    return rounded(out.drop("median_abs_error"), "precision", "recall", "f1")


_SIZES = "sized AS (SELECT series_id, start AS c, CASE WHEN ramp % 2 = 0 THEN 'small' ELSE 'big' END AS size FROM ramps)"


def _sized(ramps):
    return ramps.select("series_id", F.col("start").alias("truth"), F.when(F.col("ramp") % 2 == 0, "small").otherwise("big").alias("size"))


@query(
    "recall_by_size",
    f"""WITH RECURSIVE {Q.SER}, {_RAMPS}, {_HOT}, {_SIZES}, lists AS (SELECT a.series_id, part, 10 AS tau, p, c FROM (SELECT series_id, list(t ORDER BY t) AS p FROM hot GROUP BY 1) a
      JOIN (SELECT series_id, part, list(c ORDER BY c) AS c FROM (SELECT series_id, size AS part, c FROM sized UNION ALL SELECT series_id, 'all', c FROM sized) GROUP BY ALL) b ON a.series_id = b.series_id),
    {Q.greedy("lists", "series_id, part")}
    SELECT series_id, round(max(CASE WHEN part = 'small' THEN m / nc END), 6) AS small_recall, round(max(CASE WHEN part = 'big' THEN m / nc END), 6) AS big_recall,
    round(max(CASE WHEN part = 'all' THEN m / np END), 6) AS "precision" FROM (SELECT * REPLACE (m::DOUBLE AS m) FROM hits) GROUP BY series_id""",
)
def _(spark, sf_dir):
    series = src.events(spark, sf_dir)
    return rounded(E.recall_by_size(_hot(series), _sized(_ramps(series)), 10, ["series_id"]), "small_recall", "big_recall", "precision")


@query(
    "classified_hits",
    f"""WITH RECURSIVE {Q.SER}, {_RAMPS}, {_HOT}, {_SIZES}, lists AS (SELECT a.series_id, size, 10 AS tau, p, c FROM (SELECT series_id, list(t ORDER BY t) AS p FROM hot GROUP BY 1) a
      JOIN (SELECT series_id, size, list(c ORDER BY c) AS c FROM sized GROUP BY ALL) b ON a.series_id = b.series_id), {Q.greedy("lists", "series_id, size")}
    SELECT series_id, CAST(sum(CASE WHEN size = 'small' THEN m END) AS BIGINT) AS n_small, CAST(sum(CASE WHEN size = 'big' THEN m END) AS BIGINT) AS n_big FROM hits GROUP BY series_id""",
)
def _(spark, sf_dir):
    series = src.events(spark, sf_dir)
    out = E.classified(_hot(series), _sized(_ramps(series)), 10, ["series_id"])
    return out.groupBy("series_id").agg(F.sum(F.col("is_small").cast("int")).alias("n_small"), F.sum(F.col("is_big").cast("int")).alias("n_big"))


@query(
    "chance_recall",
    f"""WITH RECURSIVE ratios AS (SELECT * FROM (VALUES (1, 60), (3, 25)) v(ratio, n)), truths AS (SELECT ratio, k * 200 AS c FROM ratios, range(1, 33) r(k)),
    trials AS (SELECT ratio, n, trial FROM ratios, range(40) q(trial)),
    draws AS (SELECT ratio, trial, CAST('0x' || substr(md5('2026-' || ratio || '-' || trial || '-' || k), 1, 12) AS BIGINT) % 6598 + 1 AS t FROM (SELECT *, unnest(range(n)) AS k FROM trials)),
    lists AS (SELECT a.ratio, trial, 10 AS tau, p, c FROM (SELECT ratio, trial, list(t ORDER BY t) AS p FROM draws GROUP BY ALL) a JOIN (SELECT ratio, list(c ORDER BY c) AS c FROM truths GROUP BY 1) b ON a.ratio = b.ratio),
    {Q.greedy("lists", "ratio, trial")} SELECT ratio, round(sum(m)::DOUBLE / (32 * 40), 6) AS chance FROM hits GROUP BY ratio""",
)
def _(spark, sf_dir):
    counts = spark.createDataFrame([(1, 60), (3, 25)], "ratio int, n int")
    truth = counts.select("ratio", F.explode(F.sequence(F.lit(200).cast("long"), F.lit(6400).cast("long"), F.lit(200).cast("long"))).alias("truth"))
    return rounded(E.chance_recall(counts, truth, 6600, 10, 40, ["ratio"]), "chance")


# --- scores of labels ----------------------------------------------------------------------

_STATES = "lb AS (SELECT event_type AS e, CASE WHEN value < 33 THEN 0 WHEN value < 66 THEN 1 ELSE 2 END AS truth, CAST(least(floor((value + user_id % 7) / 30), 3) AS BIGINT) AS pred, value AS x FROM events)"


def _states(spark, sf_dir):
    v = F.col("value")
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("e"), F.when(v < 33, 0).when(v < 66, 1).otherwise(2).alias("truth"), F.least(F.floor((v + F.col("user_id") % 7) / 30), F.lit(3)).cast("long").alias("pred"), v.alias("x")
    )


def _v_sql(source: str, name: str) -> str:
    return f"""{name}c AS (SELECT e, truth, pred, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY e, truth)::DOUBLE AS na, sum(count(*)) OVER (PARTITION BY e, pred)::DOUBLE AS nb, sum(count(*)) OVER (PARTITION BY e)::DOUBLE AS total FROM {source} GROUP BY e, truth, pred),
    {name}h AS (SELECT e, 1 - sum(n / total * ln(n / nb)) / sum(n / total * ln(na / total)) AS h, 1 - sum(n / total * ln(n / na)) / sum(n / total * ln(nb / total)) AS c FROM {name}c GROUP BY e),
    {name} AS (SELECT e, 2 * h * c / (h + c) AS v FROM {name}h)"""


@query(
    "two_target_v",
    f"""WITH {_STATES}, lb2 AS (SELECT * FROM lb WHERE truth <> 1), {_v_sql("lb", "v3")}, {_v_sql("lb2", "v2")}
    SELECT v3.e, round(v3.v, 6) AS v3, round(v2.v, 6) AS v2, k FROM v3 JOIN v2 USING (e) JOIN (SELECT e, count(DISTINCT pred) AS k FROM lb GROUP BY e) USING (e)""",
)
def _(spark, sf_dir):
    return rounded(E.two_targets(_states(spark, sf_dir), "truth", "pred", ["e"]), "v3", "v2")


def _laws_sql(source: str, name: str, levels: int) -> str:
    side = lambda c, t: f"""{t}_{name} AS (SELECT e, {c}, m, {Q.profile('v', levels)} AS p FROM (SELECT e, {c}, count(*)::DOUBLE / any_value(total) AS m, list_sort(list(x)) AS v, count(*) AS n
      FROM (SELECT *, count(*) OVER (PARTITION BY e) AS total FROM {source}) GROUP BY e, {c}) WHERE n >= 10)"""  # noqa: E731
    return f"""{side('truth', 'tl')}, {side('pred', 'pl')},
    d_{name} AS (SELECT a.e, a.truth, b.pred, a.m AS ma, b.m AS mb, sqrt({Q.gap('a.p', 'b.p')} / {levels}) AS d FROM tl_{name} a JOIN pl_{name} b ON a.e = b.e),
    f_{name} AS (SELECT e, sum(mb * d) / sum(mb) AS fidelity FROM (SELECT e, pred, mb, min(d) AS d FROM d_{name} GROUP BY ALL) GROUP BY e),
    c_{name} AS (SELECT e, sum(ma * d) / sum(ma) AS coverage FROM (SELECT e, truth, ma, min(d) AS d FROM d_{name} GROUP BY ALL) GROUP BY e),
    s_{name} AS (SELECT a.e, sqrt({Q.gap('a.p', 'b.p')} / {levels}) AS separation FROM tl_{name} a JOIN tl_{name} b ON a.e = b.e AND a.truth = 0 AND b.truth = 2),
    r_{name} AS (SELECT e, fidelity, coverage, separation, fidelity / separation AS fn, coverage / separation AS cn FROM f_{name} JOIN c_{name} USING (e) JOIN s_{name} USING (e))"""


@query(
    "fidelity_both_targets",
    f"""WITH {_STATES}, lb2 AS (SELECT * FROM lb WHERE truth <> 1), {_laws_sql("lb", "a", 512)}, {_laws_sql("lb2", "b", 512)}
    SELECT a.e, round(a.fidelity, 6) AS fidelity3, round(a.coverage, 6) AS coverage3, round(a.separation, 6) AS separation3, round(a.fn, 6) AS fidelity_norm3, round(a.cn, 6) AS coverage_norm3,
    round(b.fidelity, 6) AS fidelity2, round(b.coverage, 6) AS coverage2, round(b.separation, 6) AS separation2, round(b.fn, 6) AS fidelity_norm2, round(b.cn, 6) AS coverage_norm2 FROM r_a a JOIN r_b b USING (e)""",
)
def _(spark, sf_dir):
    out = E.both_errors(_states(spark, sf_dir), "truth", "pred", ["e"])
    return rounded(out, *[c for c in out.columns if c != "e"])


@query(
    "cluster_report",
    f"""WITH {_STATES}, {_laws_sql("lb", "a", 512)} SELECT x.e, x.pred AS cluster, round(x.m, 6) AS mass, round(list_avg(x.p), 6) AS mean, round(list_stddev_pop(x.p), 6) AS std, y.nearest, round(y.d, 6) AS w2
    FROM pl_a x JOIN (SELECT e, pred, arg_min(truth, (d, truth)) AS nearest, min(d) AS d FROM d_a GROUP BY e, pred) y ON x.e = y.e AND x.pred = y.pred""",
)
def _(spark, sf_dir):
    return rounded(E.cluster_report(_states(spark, sf_dir), "truth", "pred", ["e"]), "mass", "mean", "std", "w2")


_COMP = """cp AS (SELECT event_type AS e, user_id % 5 AS cluster, count(DISTINCT user_id) AS n_segments, count(*) AS n_points, avg(value) AS mean_x, stddev_pop(value) AS std_x,
  avg(CAST(abs(value - 50) < 20 AS INTEGER)) AS frac_core FROM events GROUP BY ALL)"""


def _composition(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("e"), F.col("user_id").alias("seg"), (F.col("user_id") % 5).alias("c"), F.col("value").alias("x"))
    return E.composition(rows, "c", ["e"], F.abs(F.col("x") - 50) < 20)


@query("composition", f"WITH {_COMP} SELECT e, cluster, n_segments, n_points, round(mean_x, 6) AS mean_x, round(std_x, 6) AS std_x, round(frac_core, 6) AS frac_core FROM cp")
def _(spark, sf_dir):
    return rounded(_composition(spark, sf_dir), "mean_x", "std_x", "frac_core")


@query(
    "composition_flags",
    f"""WITH {_COMP} SELECT e, count(*) AS k, bool_or(frac_core > 0.4) AS has_transition_cluster, string_agg(cluster || ':' || printf('%.3f', round(mean_x, 3)), ';' ORDER BY mean_x) AS cluster_mean_x,
    string_agg(cluster || ':' || n_points, ';' ORDER BY mean_x) AS cluster_n_points, string_agg(cluster || ':' || printf('%.2f', round(frac_core, 2)), ';' ORDER BY mean_x) AS cluster_frac_core FROM cp GROUP BY e""",
)
def _(spark, sf_dir):
    return E.composition_flags(_composition(spark, sf_dir), ["e"])


@query(
    "typical_rep",
    """WITH r AS (SELECT l_linenumber AS ratio, l_suppkey AS rep, avg(l_discount) AS recall FROM lineitem GROUP BY ALL), m AS (SELECT *, round(abs(recall - avg(recall) OVER (PARTITION BY ratio)), 12) AS d FROM r)
    SELECT ratio, arg_min(rep, (d, rep)) AS rep FROM m GROUP BY ratio""",
)
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("ratio"), F.col("l_suppkey").alias("rep")).agg(F.avg("l_discount").alias("recall"))
    return E.typical_rep(rows, ["ratio"], "recall")


_RAND = "lv AS (SELECT event_id, value, user_id FROM events)"


@query(
    "rand_with_next",
    """WITH g AS (SELECT step, event_id AS p, CAST(floor(value / step) AS BIGINT) AS a FROM events, (VALUES (10.0::DOUBLE), (20.0), (50.0)) s(step)),
    t AS (SELECT x.step, x.a, y.a AS b, count(*)::DOUBLE AS n FROM g x JOIN g y ON x.p = y.p AND y.step = CASE x.step WHEN 10 THEN 20 WHEN 20 THEN 50 END GROUP BY ALL),
    s AS (SELECT step, sum(n * (n - 1) / 2) AS s, sum(n) AS total FROM t GROUP BY step), l AS (SELECT step, sum(m * (m - 1) / 2) AS sa FROM (SELECT step, a, sum(n) AS m FROM t GROUP BY ALL) GROUP BY step),
    r AS (SELECT step, sum(m * (m - 1) / 2) AS sb FROM (SELECT step, b, sum(n) AS m FROM t GROUP BY ALL) GROUP BY step)
    SELECT step, round((s - sa * sb / (total * (total - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (total * (total - 1) / 2)), 6) AS ari_next FROM s JOIN l USING (step) JOIN r USING (step)""",
)
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.explode(F.array(F.lit(10.0), F.lit(20.0), F.lit(50.0))).alias("step"), "value")
    labels = rows.select("step", "event_id", F.floor(F.col("value") / F.col("step")).alias("label"))
    return rounded(E.rand_with_next(labels, [], "step", "event_id", "label", [10.0, 20.0, 50.0]), "ari_next")


# --- result frames ---------------------------------------------------------------------------

_RES = """res AS (SELECT CAST(5 * (l_linenumber % 3) AS INTEGER) AS sigma, CAST(l_suppkey % 100 + 1 AS INTEGER) AS transition_length, CASE l_orderkey % 3 WHEN 0 THEN 'oracle' WHEN 1 THEN 'w25' ELSE 'w100' END AS window_setting,
  CAST(CASE l_orderkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 25 WHEN 2 THEN 50 ELSE 100 END AS INTEGER) AS w, CASE l_partkey % 3 WHEN 0 THEN 'gradient' WHEN 1 THEN 'run_edge' ELSE 'half_max' END AS estimator,
  [0.5::DOUBLE, 0.75, 0.95][CAST(l_partkey // 3 % 3 + 1 AS INTEGER)] AS q, l_discount AS f1_tau5, l_tax AS f1_tau10, l_discount + l_tax AS f1_tau25, l_quantity / 50.0::DOUBLE AS f1_tau50, CAST(l_quantity AS DOUBLE) AS median_abs_error, l_quantity - 25.0::DOUBLE AS median_signed_error,
  CASE WHEN l_returnflag = 'R' THEN 'no clusters' ELSE 'ok' END AS status, CASE WHEN l_suppkey % 2 = 0 THEN 'baseline' ELSE 'resample_pointwise' END AS method,
  CASE WHEN l_linestatus = 'O' THEN 'w2' ELSE 'mean' END AS detector, l_extendedprice AS cutoff, l_linenumber, l_returnflag FROM lineitem)"""


def _results(spark, sf_dir):
    c = F.col
    mod = lambda name, k, values: F.get(F.array(*[F.lit(v) for v in values]), (c(name) % k).cast("int"))
    return read(spark, sf_dir, "lineitem").select(
        (5 * (c("l_linenumber") % 3)).cast("int").alias("sigma"), (c("l_suppkey") % 100 + 1).cast("int").alias("transition_length"), mod("l_orderkey", 3, ["oracle", "w25", "w100"]).alias("window_setting"),
        mod("l_orderkey", 4, [10, 25, 50, 100]).alias("w"), mod("l_partkey", 3, ["gradient", "run_edge", "half_max"]).alias("estimator"), F.get(F.array(F.lit(0.5), F.lit(0.75), F.lit(0.95)), (F.floor(c("l_partkey") / 3) % 3).cast("int")).alias("q"),
        c("l_discount").alias("f1_tau5"), c("l_tax").alias("f1_tau10"), (c("l_discount") + c("l_tax")).alias("f1_tau25"), (c("l_quantity") / 50.0).alias("f1_tau50"), c("l_quantity").cast("double").alias("median_abs_error"), (c("l_quantity") - 25.0).alias("median_signed_error"),
        F.when(c("l_returnflag") == "R", "no clusters").otherwise("ok").alias("status"), F.when(c("l_suppkey") % 2 == 0, "baseline").otherwise("resample_pointwise").alias("method"),
        F.when(c("l_linestatus") == "O", "w2").otherwise("mean").alias("detector"), c("l_extendedprice").alias("cutoff"), "l_linenumber", "l_returnflag",
    )


def _every(df, digits=6):
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c, kind in df.dtypes if kind == "double"})


_BIN = "CASE WHEN transition_length >= 0 AND transition_length <= 10 THEN '1-10' WHEN transition_length <= 25 THEN '11-25' WHEN transition_length <= 50 THEN '26-50' WHEN transition_length <= 75 THEN '51-75' WHEN transition_length <= 100 THEN '76-100' END"
_NAMES = ["1-10", "11-25", "26-50", "51-75", "76-100"]


@query("table_detection", f"WITH {_RES} SELECT estimator, window_setting, " + ", ".join(f"round(avg(f1_tau{t}), 6) AS f1_tau{t}" for t in (5, 10, 25, 50)) + " FROM res GROUP BY estimator, window_setting")
def _(spark, sf_dir):
    return _every(B.detection(_results(spark, sf_dir)))


@query(
    "table_localisation",
    f"WITH {_RES}, b AS (SELECT *, {_BIN} AS bin FROM res) SELECT estimator, " + ", ".join(f"""round(median(CASE WHEN bin = '{n}' THEN {c} END), 6) AS "{c} {n}\"""" for c in ("median_abs_error", "median_signed_error") for n in _NAMES) + " FROM b GROUP BY estimator",
)
def _(spark, sf_dir):
    return _every(B.localisation_by_length(_results(spark, sf_dir)))


@query(
    "table_estimator_gaps",
    f"""WITH {_RES}, p AS (SELECT window_setting, sigma, transition_length, avg(CASE WHEN estimator = 'gradient' THEN median_abs_error END) AS g, avg(CASE WHEN estimator = 'run_edge' THEN median_abs_error END) AS r,
    avg(CASE WHEN estimator = 'half_max' THEN median_abs_error END) AS h FROM res GROUP BY ALL), d AS (SELECT 'gradient vs run_edge' AS pair, abs(g - r) AS gap FROM p UNION ALL SELECT 'gradient vs half_max', abs(g - h) FROM p UNION ALL SELECT 'run_edge vs half_max', abs(r - h) FROM p)
    SELECT pair, round(avg(gap), 6) AS mean_gap, round(median(gap), 6) AS median_gap, round(quantile_cont(gap, 0.9), 6) AS p90_gap FROM d GROUP BY pair""",
)
def _(spark, sf_dir):
    return _every(B.estimator_gaps(_results(spark, sf_dir)))


@query("table_window_choice", f"WITH {_RES}, b AS (SELECT *, {_BIN} AS bin FROM res WHERE estimator = 'gradient') SELECT window_setting, " + ", ".join(f"""round(avg(CASE WHEN bin = '{n}' THEN f1_tau50 END), 6) AS "{n}\"""" for n in _NAMES) + " FROM b GROUP BY window_setting")
def _(spark, sf_dir):
    return _every(B.window_choice(_results(spark, sf_dir)))


_THR = "thr AS (SELECT sigma, transition_length, q, round(1 - 19 * transition_length / (5000.0::DOUBLE + 19 * transition_length), 6) AS q_star, round(avg(median_abs_error), 9) AS median_abs_error, round(avg(f1_tau10), 9) AS f1_tau10 FROM res GROUP BY sigma, transition_length, q)"


def _thresholds(spark, sf_dir):
    rows = _results(spark, sf_dir).groupBy("sigma", "transition_length", "q").agg(F.round(F.avg("median_abs_error"), 9).alias("median_abs_error"), F.round(F.avg("f1_tau10"), 9).alias("f1_tau10"))
    return rows.withColumn("q_star", F.round(P.expected_quantile(F.col("transition_length")), 6))


@query(
    "table_threshold_diagnosis",
    f"""WITH {_RES}, {_THR}, best AS (SELECT * FROM thr QUALIFY row_number() OVER (PARTITION BY sigma, transition_length ORDER BY median_abs_error, q) = 1),
    f AS (SELECT transition_length, median(median_abs_error) AS e FROM thr WHERE q = 0.95 GROUP BY 1)
    SELECT b.transition_length, round(median(q), 6) AS best_q, round(median(q_star), 6) AS q_star, round(median(median_abs_error), 6) AS error_at_best, round(any_value(e), 6) AS error_at_fixed
    FROM best b LEFT JOIN f ON b.transition_length = f.transition_length WHERE b.transition_length IN (1, 5, 10, 20, 40, 60, 80, 100) GROUP BY b.transition_length""",
)
def _(spark, sf_dir):
    return _every(B.threshold_diagnosis(_thresholds(spark, sf_dir)))


@query(
    "best_level",
    f"""WITH {_RES}, {_THR}, m AS (SELECT *, max(f1_tau10) OVER (PARTITION BY sigma, transition_length) AS top FROM thr) SELECT sigma, transition_length, arg_min(q, (median_abs_error, q)) AS q FROM m WHERE f1_tau10 >= top - 1e-9 GROUP BY ALL""",
)
def _(spark, sf_dir):
    return E.best_level(_thresholds(spark, sf_dir), ["sigma", "transition_length"])


_PRIOR = f"""WITH {_RES}, g AS (SELECT window_setting, sigma, transition_length, round(f1_tau25, 9) AS f FROM res WHERE estimator = 'gradient'),
r AS (SELECT *, rank() OVER (PARTITION BY window_setting, sigma ORDER BY transition_length) + (count(*) OVER (PARTITION BY window_setting, sigma, transition_length) - 1) / 2 AS a,
rank() OVER (PARTITION BY window_setting, sigma ORDER BY f) + (count(*) OVER (PARTITION BY window_setting, sigma, f) - 1) / 2 AS b FROM g)
SELECT window_setting, sigma, round(corr(a, b), 6) AS rho, count(*) AS n, round(avg(f), 6) AS mean FROM r GROUP BY ALL"""


def _prior(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumn("f1_tau25", F.round("f1_tau25", 9))
    return B.prior_tests(rows, "transition_length", ["window_setting", "sigma"])


@query("table_prior_tests", _PRIOR)
def _(spark, sf_dir):
    return _every(_prior(spark, sf_dir))


@query("table_prior_p_values")
def _(spark, sf_dir):
    return B.with_p_value(_prior(spark, sf_dir))


_QUALITY = {"v3_adp": "f1_tau5", "v2_adp": "f1_tau10", "v3_kmeans": "f1_tau25"}


@query(
    "table_quality_by_noise",
    f"WITH {_RES} SELECT sigma, count(*) AS n, CAST(sum(CAST(status <> 'ok' AS INTEGER)) AS BIGINT) AS n_failed, round(avg(f1_tau5), 6) AS v3_adp, round(avg(f1_tau10), 6) AS v2_adp, round(avg(f1_tau25), 6) AS v3_kmeans FROM res GROUP BY sigma",
)
def _(spark, sf_dir):
    return _every(B.quality_by_noise(_results(spark, sf_dir), _QUALITY, failed=True))


_FIFTH = "CASE WHEN transition_length > 0 AND transition_length <= 20 THEN '(0, 20]' WHEN transition_length <= 40 THEN '(20, 40]' WHEN transition_length <= 60 THEN '(40, 60]' WHEN transition_length <= 80 THEN '(60, 80]' WHEN transition_length <= 101 THEN '(80, 101]' END"


@query(
    "table_quality_by_length",
    f"WITH {_RES} SELECT sigma, {_FIFTH} AS tl_bin, round_even(avg(f1_tau50), 3) AS f1_tau50, round_even(avg(median_abs_error), 3) AS median_abs_error FROM res WHERE status = 'ok' AND sigma > 0 GROUP BY ALL",
)
def _(spark, sf_dir):
    return B.quality_by_length(_results(spark, sf_dir), ["f1_tau50", "median_abs_error"])


@query(
    "table_localisation_gap",
    f"""WITH {_RES}, o AS (SELECT *, CASE WHEN l_linenumber < 6 THEN f1_tau50 END AS oracle FROM res WHERE status = 'ok' AND sigma > 0)
    SELECT sigma, count(*) AS n, round_even(avg(f1_tau10), 3) AS found, round_even(avg(oracle), 3) AS oracle, round_even(avg(oracle - f1_tau10), 3) AS gap, round_even(avg(oracle - f1_tau10) / (1 - avg(f1_tau10)), 3) AS frac_of_shortfall FROM o WHERE oracle IS NOT NULL GROUP BY sigma""",
)
def _(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumn("oracle", F.when(F.col("l_linenumber") < 6, F.col("f1_tau50")))
    return B.localisation_gap(rows, "f1_tau10", "oracle")


@query(
    "table_win_rates",
    f"""WITH {_RES}, o AS (SELECT *, CASE WHEN l_linenumber < 6 THEN f1_tau25 END AS oracle FROM res WHERE status = 'ok')
    SELECT sigma, count(*) AS n, round_even(avg(CAST(f1_tau10 < f1_tau5 AS INTEGER)), 3) AS adp, round_even(sum(CAST(oracle < f1_tau5 AS INTEGER)) / nullif(count(oracle), 0)::DOUBLE, 3) AS oracle FROM o GROUP BY sigma""",
)
def _(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumn("oracle", F.when(F.col("l_linenumber") < 6, F.col("f1_tau25")))
    return B.win_rates(rows, {"adp": "f1_tau10", "oracle": "oracle"}, "f1_tau5")


@query("table_f1_by_w_and_q", f"WITH {_RES} SELECT w, round_even(avg(CASE WHEN q = 0.5 THEN f1_tau10 END), 3) AS \"0.5\", round_even(avg(CASE WHEN q = 0.75 THEN f1_tau10 END), 3) AS \"0.75\", round_even(avg(CASE WHEN q = 0.95 THEN f1_tau10 END), 3) AS \"0.95\" FROM res WHERE method = 'baseline' GROUP BY w")
def _(spark, sf_dir):
    rows = _results(spark, sf_dir).where("method = 'baseline'")
    return B.rounded(rows.groupBy("w").pivot("q", [0.5, 0.75, 0.95]).agg(F.avg("f1_tau10")))


@query(
    "table_best_by_window",
    f"""WITH {_RES}, c AS (SELECT w, q, avg(f1_tau10) AS f FROM res GROUP BY w, q), a AS (SELECT CAST(w AS VARCHAR) AS w, q, f FROM c UNION ALL SELECT 'worst case', q, min(f) FROM c GROUP BY q)
    SELECT 'all' AS arm, w, round_even(q, 3) AS best_q, round_even(f, 3) AS f1_at_best_q FROM a QUALIFY row_number() OVER (PARTITION BY w ORDER BY f DESC, q) = 1""",
)
def _(spark, sf_dir):
    return B.best_by_window(_results(spark, sf_dir), "all")


@query(
    "table_cutoff_alignment",
    f"""WITH {_RES}, m AS (SELECT method, w, q, median(cutoff) AS c FROM res GROUP BY ALL), o AS (SELECT w, q, c FROM m WHERE method = 'baseline'), n AS (SELECT w, c FROM m WHERE method <> 'baseline' AND q = 0.5),
    lo AS (SELECT n.w, max(o.c) AS x0, arg_max(q, o.c) AS y0 FROM n JOIN o ON o.w = n.w AND o.c <= n.c GROUP BY n.w), hi AS (SELECT n.w, min(o.c) AS x1, arg_min(q, o.c) AS y1 FROM n JOIN o ON o.w = n.w AND o.c >= n.c GROUP BY n.w)
    SELECT n.w, round_even(n.c, 3) AS null_cutoff, round_even(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = n.c THEN y0 ELSE y0 + (n.c - x0) * (y1 - y0) / (x1 - x0) END, 3) AS observed_quantile, round_even(b.c, 3) AS baseline_cutoff
    FROM n LEFT JOIN lo USING (w) LEFT JOIN hi USING (w) LEFT JOIN o b ON b.w = n.w AND b.q = 0.75""",
)
def _(spark, sf_dir):
    return B.cutoff_alignment(_results(spark, sf_dir))


_QUART = "CASE WHEN transition_length > 0 AND transition_length <= 25 THEN '(0, 25]' WHEN transition_length <= 50 THEN '(25, 50]' WHEN transition_length <= 75 THEN '(50, 75]' WHEN transition_length <= 101 THEN '(75, 101]' END"


@query("table_f1_by_w_and_length", f"WITH {_RES}, b AS (SELECT *, {_QUART} AS bin FROM res WHERE q = 0.75) SELECT w, " + ", ".join(f"""round_even(avg(CASE WHEN bin = '{n}' THEN f1_tau10 END), 3) AS "{n}\"""" for n in ("(0, 25]", "(25, 50]", "(50, 75]", "(75, 101]")) + " FROM b GROUP BY w")
def _(spark, sf_dir):
    return B.rounded(B.by_bin(_results(spark, sf_dir).where("q = 0.75"), ["w"], "f1_tau10", B.QUARTERS))


_GRID = "grd AS (SELECT sigma AS noise_sigma, transition_length, CAST(q * 2 - 0.5 AS DOUBLE) AS sigma, CAST(l_linenumber AS BIGINT) AS eigengap_k, round(f1_tau10, 9) AS v3, f1_tau25 AS v2, f1_tau5 AS ari FROM res)"


def _grid(spark, sf_dir):
    return _results(spark, sf_dir).select(
        F.col("sigma").alias("noise_sigma"), "transition_length", (F.col("q") * 2 - 0.5).alias("sigma"), F.col("l_linenumber").alias("eigengap_k"), F.round("f1_tau10", 9).alias("v3"), F.col("f1_tau25").alias("v2"), F.col("f1_tau5").alias("ari")
    )


@query(
    "table_sigma_rules",
    f"""WITH {_RES}, {_GRID}, cells AS (SELECT noise_sigma, transition_length, sigma, round(avg(v3), 9) AS v3, round(avg(v2), 9) AS v2 FROM grd GROUP BY ALL),
    b AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY noise_sigma, transition_length ORDER BY v3 DESC, sigma) = 1),
    u AS (SELECT 'fixed (code)' AS rule, * FROM cells WHERE sigma = 0.5 UNION ALL SELECT 'fixed (paper)', * FROM cells WHERE abs(sigma - 1.4) < 1e-9 UNION ALL SELECT 'median heuristic', * FROM cells WHERE sigma = 1.0 UNION ALL SELECT 'best (ceiling)', * FROM b)
    SELECT rule, noise_sigma, round_even(avg(sigma), 3) AS mean_sigma, round_even(avg(v3), 3) AS v3, round_even(avg(v2), 3) AS v2 FROM u GROUP BY rule, noise_sigma""",
)
def _(spark, sf_dir):
    cells = _grid(spark, sf_dir).groupBy("noise_sigma", "transition_length", "sigma").agg(F.round(F.avg("v3"), 9).alias("v3"), F.round(F.avg("v2"), 9).alias("v2"))
    return B.sigma_rules(cells, cells.where("sigma = 1.0"), ["v3", "v2"], paper=1.4)


@query(
    "table_eigengaps",
    f"WITH {_RES}, {_GRID} SELECT sigma, round_even(median(eigengap_k), 3) AS k_median, round_even(avg(eigengap_k), 3) AS k_mean, round_even(avg(CAST(eigengap_k = 3 AS INTEGER)), 3) AS frac_k_eq_3, round_even(avg(v3), 3) AS v3, round_even(avg(ari), 3) AS ari FROM grd WHERE noise_sigma > 0 GROUP BY sigma",
)
def _(spark, sf_dir):
    return B.eigengaps(_grid(spark, sf_dir))


_ARMS = "arm AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'mean' WHEN 1 THEN 'variance' ELSE 'both' END AS kind, sigma AS separation, CAST(transition_length % 3 * 25 AS INTEGER) AS transition_length, w, detector, CASE WHEN l_returnflag = 'N' THEN 'peak' ELSE 'gradient' END AS extractor, q, round(f1_tau10, 9) AS f1_tau10 FROM res)"
_BEST = """cells AS (SELECT kind, separation, transition_length, w, detector, extractor, q, round(avg(f1_tau10), 9) AS mean, stddev_samp(f1_tau10) AS std, count(*) AS n FROM arm GROUP BY ALL),
bst AS (SELECT * EXCLUDE (q) FROM cells QUALIFY row_number() OVER (PARTITION BY kind, separation, transition_length, w, detector, extractor ORDER BY mean DESC, q) = 1)"""


def _best_levels(spark, sf_dir):
    rows = _results(spark, sf_dir)
    kind = F.get(F.array(F.lit("mean"), F.lit("variance"), F.lit("both")), (F.col("l_linenumber") % 3).cast("int"))
    arms = rows.select(
        kind.alias("kind"), F.col("sigma").alias("separation"), (F.col("transition_length") % 3 * 25).alias("transition_length"), "w", "detector", F.when(F.col("l_returnflag") == "N", "peak").otherwise("gradient").alias("extractor"), "q", F.round("f1_tau10", 9).alias("f1_tau10")
    )
    cells = arms.groupBy(*B.CELL, "q").agg(F.round(F.avg("f1_tau10"), 9).alias("mean"), F.stddev_samp("f1_tau10").alias("std"), F.count("*").alias("n"))
    from ..operators import reports as R

    return R.arg_row(cells, B.CELL, "mean", ["q"], largest=True).drop("q")


@query("table_best_levels", f"WITH {_RES}, {_ARMS}, {_BEST} SELECT kind, separation, transition_length, w, detector, extractor, round(mean, 6) AS mean, round(std, 6) AS std, n FROM bst")
def _(spark, sf_dir):
    return _every(_best_levels(spark, sf_dir))


for _name, _value in (("f1", "mean"), ("std", "std")):

    @query(
        f"table_instantaneous_{_name}",
        f"WITH {_RES}, {_ARMS}, {_BEST} SELECT kind, separation, " + ", ".join(f"""round_even(avg(CASE WHEN w = {w} AND detector = '{d}' THEN {_value} END), 3) AS "w{w} {d}\"""" for w in (10, 25) for d in ("mean", "w2")) + " FROM bst WHERE transition_length = 0 AND extractor = 'peak' GROUP BY kind, separation",
    )
    def _(spark, sf_dir, value=_value):
        return B.instantaneous(_best_levels(spark, sf_dir), value, [10, 25])


@query(
    "table_gradual",
    f"WITH {_RES}, {_ARMS}, {_BEST} SELECT kind, separation, " + ", ".join(f"""round_even(avg(CASE WHEN transition_length = {n} AND detector = '{d}' THEN mean END), 3) AS "tl{n} {d}\"""" for n in (25, 50) for d in ("mean", "w2")) + " FROM bst WHERE transition_length > 0 AND extractor = 'gradient' AND w = 50 GROUP BY kind, separation",
)
def _(spark, sf_dir):
    return B.gradual(_best_levels(spark, sf_dir), [25, 50])


@query(
    "table_head_to_head",
    f"""WITH {_RES}, {_ARMS}, {_BEST}, p AS (SELECT kind, transition_length, w, extractor, separation, avg(CASE WHEN detector = 'w2' THEN mean END) AS a, avg(CASE WHEN detector = 'mean' THEN mean END) AS b FROM bst GROUP BY ALL)
    SELECT kind, w, round_even(avg(a), 3) AS w2, round_even(avg(b), 3) AS mean, round_even(avg(a - b), 3) + 0.0::DOUBLE AS w2_minus_mean FROM p GROUP BY kind, w""",
)
def _(spark, sf_dir):
    return B.head_to_head(_best_levels(spark, sf_dir))


@query(
    "table_window_dependence",
    f"WITH {_RES}, {_ARMS}, {_BEST} SELECT kind, detector, " + ", ".join(f"round_even(avg(CASE WHEN w = {w} THEN mean END), 3) AS w{w}" for w in (10, 25, 50, 100)) + " FROM bst WHERE transition_length = 0 AND extractor = 'peak' GROUP BY kind, detector",
)
def _(spark, sf_dir):
    return B.window_dependence(_best_levels(spark, sf_dir), [10, 25, 50, 100])


@query(
    "table_scheme_robustness",
    f"""WITH {_RES}, s AS (SELECT w AS block_length, CASE WHEN l_linenumber < 3 THEN 'circular' WHEN l_linenumber < 5 THEN 'moving' ELSE 'full_shuffle' END AS scheme, f1_tau50 AS o, median_abs_error AS n FROM res)
    SELECT block_length, round_even(avg(CASE WHEN scheme = 'circular' THEN o END), 4) AS "cutoff_obs_quantile circular", round_even(avg(CASE WHEN scheme = 'moving' THEN o END), 4) AS "cutoff_obs_quantile moving",
    round_even(avg(CASE WHEN scheme = 'circular' THEN n END), 4) AS "n_segments circular", round_even(avg(CASE WHEN scheme = 'moving' THEN n END), 4) AS "n_segments moving" FROM s WHERE scheme <> 'full_shuffle' GROUP BY block_length""",
)
def _(spark, sf_dir):
    mode = F.when(F.col("l_linenumber") < 3, "circular").when(F.col("l_linenumber") < 5, "moving").otherwise("full_shuffle")
    rows = _results(spark, sf_dir).select(F.col("w").alias("block_length"), mode.alias("scheme"), F.col("f1_tau50").alias("cutoff_obs_quantile"), F.col("median_abs_error").alias("n_segments"))
    return B.scheme_robustness(rows)


@query(
    "table_by_block_length",
    f"WITH {_RES} SELECT method, CASE WHEN w < 50 THEN w::DOUBLE END AS block_length, round_even(avg(f1_tau10), 3) AS f1_tau10, round_even(avg(median_abs_error), 3) AS median_abs_error FROM res GROUP BY ALL",
)
def _(spark, sf_dir):
    return B.by_block_length(_results(spark, sf_dir).withColumn("block_length", F.when(F.col("w") < 50, F.col("w").cast("double"))), ["f1_tau10", "median_abs_error"])


@query(
    "table_above_chance",
    f"WITH {_RES}, o AS (SELECT method, w, avg(f1_tau50) AS recall FROM res GROUP BY ALL), c AS (SELECT method, w, avg(f1_tau10) AS chance FROM res GROUP BY ALL) SELECT method, w, round(recall, 6) AS recall, round(chance, 6) AS chance, round(recall - chance, 6) AS above FROM o JOIN c USING (method, w)",
)
def _(spark, sf_dir):
    rows = _results(spark, sf_dir).groupBy("method", "w")
    return _every(B.above_chance(rows.agg(F.avg("f1_tau50").alias("recall")), rows.agg(F.avg("f1_tau10").alias("chance")), ["method", "w"]))


@query("table_curve_by_tau", f"WITH {_RES}, u AS (UNPIVOT (SELECT estimator, f1_tau5, f1_tau10, f1_tau25, f1_tau50 FROM res) ON f1_tau5, f1_tau10, f1_tau25, f1_tau50 INTO NAME name VALUE f1) SELECT estimator, CAST(substr(name, 7) AS INTEGER) AS tau, round(avg(f1), 6) AS f1 FROM u GROUP BY ALL")
def _(spark, sf_dir):
    rows = _results(spark, sf_dir).unpivot(["estimator"], ["f1_tau5", "f1_tau10", "f1_tau25", "f1_tau50"], "name", "f1")
    return rounded(rows.groupBy("estimator", F.substring("name", 7, 3).cast("int").alias("tau")).agg(F.avg("f1").alias("f1")), "f1")


@query("page_of_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 100")
def _(spark, sf_dir):
    return B.page(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 100, 25)


@query("ordered_categories", "SELECT o_orderpriority, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END AS INTEGER) AS place, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return rows.withColumn("place", B.ordinal("o_orderpriority", ["1-URGENT", "3-MEDIUM", "5-LOW"])).orderBy("place", "o_orderpriority")


@query(
    "unique_with_inverse",
    """WITH f AS (SELECT p_size, p_brand, min(p_partkey) AS representative FROM part GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY representative) - 1 AS "distinct" FROM f)
    SELECT p_partkey, p_size, p_brand, representative, "distinct" FROM part JOIN d USING (p_size, p_brand)""",
)
def _(spark, sf_dir):
    return B.with_inverse(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), "p_brand", ["p_size"], "p_partkey")
