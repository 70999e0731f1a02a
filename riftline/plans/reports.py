"""Registered queries of the report algebra, the kernels and the generators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clustering as C
from ..operators import distances as D
from ..operators import generators as G
from ..operators import reports as R
from ..operators import scoring as M
from ..operators import segments as S
from ..operators import windows as W
from ..operators.model import SegmentClusterer, top_labels
from ..sources import series as src
from ..sources import sinks
from . import sqltext as Q
from .catalog import LEVEL, cut_segments, query, read, rounded


@query(
    "group_means",
    "SELECT p_brand, round(avg(p_retailprice), 6) AS mean_price, round(avg(p_size), 6) AS mean_size FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand",
)
def _(spark, sf_dir):
    out = read(spark, sf_dir, "part").where("p_brand is not null").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean_price"), F.avg("p_size").alias("mean_size"))
    return rounded(out, "mean_price", "mean_size")


@query("group_median", "SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS median_price FROM lineitem GROUP BY ALL")
def _(spark, sf_dir):
    return rounded(read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.median("l_extendedprice").alias("median_price")), "median_price")


@query(
    "named_aggregates",
    """SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS BIGINT) AS n_failed, round(avg(o_totalprice), 4) AS mean_price,
    round(avg(CAST(o_totalprice > 100000 AS INTEGER)), 6) AS share_large FROM orders GROUP BY o_orderpriority""",
)
def _(spark, sf_dir):
    out = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("n_failed"), F.avg("o_totalprice").alias("mean_price"), F.avg((F.col("o_totalprice") > 100000).cast("int")).alias("share_large")
    )
    return rounded(rounded(out, "mean_price", digits=4), "share_large")


@query(
    "mean_std_error",
    "SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, count(*) AS n, round(stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS se FROM customer GROUP BY c_mktsegment",
)
def _(spark, sf_dir):
    std = F.stddev_samp("c_acctbal")
    out = read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean"), std.alias("std"), F.count("*").alias("n"), (std / F.sqrt(F.count("*"))).alias("se"))
    return rounded(out, "mean", "std", "se")


@query(
    "null_keys_kept",
    "SELECT CASE WHEN p_size > 25 THEN p_brand END AS brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY ALL",
)
def _(spark, sf_dir):
    out = read(spark, sf_dir, "part").groupBy(F.when(F.col("p_size") > 25, F.col("p_brand")).alias("brand")).agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("mean_price"))
    return rounded(out, "mean_price")


@query(
    "argmin_per_group",
    """SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) = 1""",
)
def _(spark, sf_dir):
    return R.arg_row(read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], "s_acctbal", ["s_suppkey"])


@query(
    "argmax_per_group",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
)
def _(spark, sf_dir):
    return R.arg_row(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", ["o_orderkey"], largest=True)


@query(
    "pivot_mean",
    """SELECT l_linestatus, round(avg(CASE WHEN l_returnflag = 'A' THEN l_discount END), 6) AS A, round(avg(CASE WHEN l_returnflag = 'N' THEN l_discount END), 6) AS N,
    round(avg(CASE WHEN l_returnflag = 'R' THEN l_discount END), 6) AS R FROM lineitem GROUP BY l_linestatus""",
)
def _(spark, sf_dir):
    return rounded(read(spark, sf_dir, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_discount")), "A", "N", "R")


@query(
    "worst_case_best_column",
    """WITH m AS (SELECT event_type, user_id % 5 AS q, avg(value) AS f FROM events GROUP BY ALL), w AS (SELECT q, min(f) AS worst FROM m GROUP BY q)
    SELECT q, round(worst, 6) AS worst FROM w ORDER BY worst DESC, q LIMIT 1""",
)
def _(spark, sf_dir):
    m = read(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("q")).agg(F.avg("value").alias("f"))
    worst = m.groupBy("q").agg(F.min("f").alias("worst"))
    return rounded(worst.orderBy(F.col("worst").desc(), "q").limit(1), "worst")


@query(
    "reaggregate_difference",
    """WITH m AS (SELECT l_returnflag AS f, l_linestatus AS s, extract('year' FROM l_shipdate) AS y, avg(l_discount) AS d FROM lineitem GROUP BY ALL),
    w AS (SELECT y, avg(CASE WHEN s = 'O' THEN d END) AS o, avg(CASE WHEN s = 'F' THEN d END) AS f FROM m GROUP BY y) SELECT y AS year, round(o, 6) AS o, round(f, 6) AS f, round(o - f, 6) AS gap FROM w""",
)
def _(spark, sf_dir):
    m = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", F.year("l_shipdate").cast("long").alias("year")).agg(F.avg("l_discount").alias("d"))
    arm = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("d")))
    return rounded(m.groupBy("year").agg(arm("O").alias("o"), arm("F").alias("f"), (arm("O") - arm("F")).alias("gap")), "o", "f", "gap")


_SIZE_BINS = ([0, 10, 25, 50, 75, 100], ["1-10", "11-25", "26-50", "51-75", "76-100"])


@query(
    "binned_mean",
    """SELECT CASE WHEN p_size >= 0 AND p_size <= 10 THEN '1-10' WHEN p_size <= 25 THEN '11-25' WHEN p_size <= 50 THEN '26-50' WHEN p_size <= 75 THEN '51-75' WHEN p_size <= 100 THEN '76-100' END AS bin,
    count(*) AS n, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY ALL""",
)
def _(spark, sf_dir):
    out = read(spark, sf_dir, "part").groupBy(R.cut(F.col("p_size"), *_SIZE_BINS, include_lowest=True).alias("bin"))
    return rounded(out.agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("mean_price")), "mean_price")


@query(
    "pairwise_gap",
    """WITH g AS (SELECT a.l_linenumber AS i, b.l_linenumber AS j, abs(a.l_quantity - b.l_quantity) AS gap FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
    SELECT i, j, round(avg(gap), 6) AS mean_gap, median(gap) AS median_gap, round(quantile_cont(gap, 0.9), 6) AS p90_gap FROM g GROUP BY i, j""",
)
def _(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("x"))
    g = a.join(a.select("l_orderkey", F.col("i").alias("j"), F.col("x").alias("y")), "l_orderkey").where("i < j").withColumn("gap", F.abs(F.col("x") - F.col("y")))
    return rounded(g.groupBy("i", "j").agg(F.avg("gap").alias("mean_gap"), F.median("gap").alias("median_gap"), F.percentile("gap", 0.9).alias("p90_gap")), "mean_gap", "p90_gap")


@query(
    "win_rate",
    """SELECT source, round(avg(CAST(quality > toxic AS INTEGER)), 6) AS win_rate, round(sum(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(toxic), 0), 6) AS conditional
    FROM documents JOIN labels USING (doc_id) GROUP BY source""",
)
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    both = F.sum(F.when((F.col("toxic") == 1) & (F.col("quality") == 1), 1).otherwise(0))
    return rounded(rows.groupBy("source").agg(F.avg((F.col("quality") > F.col("toxic")).cast("int")).alias("win_rate"), (both / F.nullif(F.sum("toxic"), F.lit(0))).alias("conditional")), "win_rate", "conditional")


@query(
    "shortfall_ratio",
    "SELECT lang, round((max(m) - avg(m)) / nullif(1 - avg(m), 0), 6) AS frac FROM (SELECT lang, source, avg(quality) AS m FROM documents JOIN labels USING (doc_id) GROUP BY lang, source) GROUP BY lang",
)
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    m = rows.groupBy("lang", "source").agg(F.avg("quality").alias("m")).groupBy("lang")
    return rounded(m.agg(((F.max("m") - F.avg("m")) / F.nullif(1 - F.avg("m"), F.lit(0.0))).alias("frac")), "frac")


@query(
    "spearman",
    """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS b FROM lineitem)
    SELECT l_returnflag, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY l_returnflag""",
)
def _(spark, sf_dir):
    return rounded(R.spearman(read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"]), "rho")


@query("pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag")
def _(spark, sf_dir):
    return rounded(read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r")), "r")


@query(
    "interp_lookup",
    """WITH p AS (SELECT p_brand AS b, p_size * 1.0::DOUBLE AS x, avg(p_retailprice) AS y FROM part GROUP BY ALL), c AS (SELECT DISTINCT p_brand AS b, c FROM part, (VALUES (0.5::DOUBLE), (10.5), (25.0), (60.0)) v(c)),
    l AS (SELECT c.b, c, max(x) AS x0, arg_max(y, x) AS y0 FROM c JOIN p ON p.b = c.b AND x <= c GROUP BY ALL), h AS (SELECT c.b, c, min(x) AS x1, arg_min(y, x) AS y1 FROM c JOIN p ON p.b = c.b AND x >= c GROUP BY ALL)
    SELECT b, c, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = c THEN y0 ELSE y0 + (c - x0) * (y1 - y0) / (x1 - x0) END, 6) AS y FROM c LEFT JOIN l USING (b, c) LEFT JOIN h USING (b, c)""",
)
def _(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    points = part.groupBy(F.col("p_brand").alias("b"), F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    at = part.select(F.col("p_brand").alias("b")).distinct().withColumn("c", F.explode(F.array(*[F.lit(v) for v in (0.5, 10.5, 25.0, 60.0)])))
    return rounded(R.interpolate(points, at, "x", "y", ["b"], "c"), "y")


@query(
    "histogram",
    "SELECT event_type, CAST(least(floor((value - 0) / (100.0::DOUBLE / 30)), 29) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 100 GROUP BY ALL",
)
def _(spark, sf_dir):
    return R.histogram(read(spark, sf_dir, "events"), "value", 0.0, 100.0, 30, ["event_type"])


@query("distinct_counts", "SELECT lang, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count_distinct("source").alias("n_sources"))


@query("value_counts_rank", "SELECT o_orderpriority, count(*) AS n, dense_rank() OVER (ORDER BY count(*) DESC) AS rank FROM orders GROUP BY o_orderpriority")
def _(spark, sf_dir):
    counts = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.dense_rank().over(Window.orderBy(F.col("n").desc())).cast("long"))  # one row a priority


@query(
    "topn_semi",
    """WITH t AS (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 10) SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM t)""",
)
def _(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    top = orders.groupBy("o_custkey").count().orderBy(F.col("count").desc(), "o_custkey").limit(10)
    return orders.join(F.broadcast(top.select("o_custkey")), "o_custkey", "left_semi")  # ten rows


@query("resume_antijoin", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, sf_dir):
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return sinks.remaining(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), done, ["c_custkey"])


@query("left_index_join", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    out = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query(
    "stratified_sample",
    """WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
    SELECT c_mktsegment, c_custkey FROM r WHERE list_contains(list_transform(range(20), lambda i: CAST(round_even(i * (n - 1) / 19.0::DOUBLE, 0) AS BIGINT)), k)""",
)
def _(spark, sf_dir):
    return R.stratified(read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), ["c_custkey"], ["c_mktsegment"], 20)


@query("strided_sample", "SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k FROM supplier) WHERE k % 2 = 0 AND k < 6")
def _(spark, sf_dir):
    return R.strided(read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), ["s_suppkey"], ["s_nationkey"], 2, 3)


@query("drop_duplicates_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("r"))
    return rows.select("o_custkey", "r.*")


@query(
    "paired_methods",
    """WITH a AS (SELECT user_id, avg(value) AS x FROM events WHERE event_type = 'click' GROUP BY user_id), b AS (SELECT user_id, avg(value) AS y FROM events WHERE event_type = 'view' GROUP BY user_id)
    SELECT user_id, round(x - y, 6) AS diff FROM a JOIN b USING (user_id)""",
)
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    arm = lambda kind, name: rows.where(F.col("event_type") == kind).groupBy("user_id").agg(F.avg("value").alias(name))
    return rounded(arm("click", "x").join(arm("view", "y"), "user_id").select("user_id", (F.col("x") - F.col("y")).alias("diff")), "diff")


@query(
    "parameter_grid",
    "SELECT s.s_suppkey, q.q, tau.tau, round(1 - 19 * s.s_suppkey / (5000.0::DOUBLE + 19 * s.s_suppkey), 6) AS q_star FROM supplier s, (VALUES (0.5::DOUBLE), (0.95)) q(q), (VALUES (5), (10)) tau(tau)",
)
def _(spark, sf_dir):
    grid = read(spark, sf_dir, "supplier").select("s_suppkey").withColumn("q", F.explode(F.array(F.lit(0.5), F.lit(0.95)))).withColumn("tau", F.explode(F.array(F.lit(5), F.lit(10))))
    return rounded(grid.withColumn("q_star", 1 - 19 * F.col("s_suppkey") / (5000.0 + 19 * F.col("s_suppkey"))), "q_star")


@query("core_set_labels", "SELECT event_id, CASE WHEN value - 50 < -10 THEN 'A' WHEN value - 50 > 10 THEN 'B' ELSE 'transition' END AS state FROM events")
def _(spark, sf_dir):
    x = F.col("value") - 50
    return read(spark, sf_dir, "events").select("event_id", F.when(x < -10, "A").when(x > 10, "B").otherwise("transition").alias("state"))


# --- kernels -----------------------------------------------------------------


def _labels(spark, sf_dir, method):
    """Of change-point segments."""
    series, segs = cut_segments(spark, sf_dir, True)
    return C.profile_labels(S.samples(series, segs), method, levels=512)


@query("adp_segments")
def _(spark, sf_dir):
    return _labels(spark, sf_dir, "adp")


@query("spectral_segments")
def _(spark, sf_dir):
    return _labels(spark, sf_dir, "spectral")


@query("sigma_sweep")
def _(spark, sf_dir):
    series, segs = cut_segments(spark, sf_dir, True)
    return C.profile_sigma_sweep(S.samples(series, segs), C.SIGMAS, levels=512)


@query("kmeans_values")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.col("value").alias("x"))
    return C.value_clusters(rows, 3)


@query("circle_segment_w2")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.lit(0.0).alias("q"), (F.dayofmonth("ts") % 4).cast("long").alias("seg"), ((F.hour("ts") * 60 + F.minute("ts")) / 1440.0).alias("x"))
    return D.circle_distances(rows.groupBy("series_id", "q", "seg").agg(F.array_sort(F.collect_list("x")).alias("v")))


@query("pca_components")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return D.project(rows, ["l_quantity", "l_discount", "l_tax"])


@query(
    "pca_two_columns",
    """WITH c AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount) AS b, var_samp(l_discount) AS d FROM lineitem), e AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS m FROM c),
    v AS (SELECT (m - d) / sqrt((m - d) * (m - d) + b * b) AS p, b / sqrt((m - d) * (m - d) + b * b) AS q FROM e)
    SELECT l_orderkey, l_linenumber, round(l_quantity * p + l_discount * q, 5) AS pc1, round(l_discount * p - l_quantity * q, 5) AS pc2 FROM lineitem, v""",
)
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(D.project(rows, ["l_quantity", "l_discount"]), "pc1", "pc2", digits=5).select("l_orderkey", "l_linenumber", "pc1", "pc2")


@query("fit_predict")
def _(spark, sf_dir):
    series = src.events(spark, sf_dir).withColumn("dim", F.lit(0))
    return SegmentClusterer(window=100, quantile=0.95, method="spectral").fit_predict(series, [0])


@query("fit_predict_adp")
def _(spark, sf_dir):
    series = src.events(spark, sf_dir).withColumn("dim", F.lit(0))
    return SegmentClusterer(window=100, quantile=0.75, method="adp").fit_predict(series, [0])


@query("grid_scores")
def _(spark, sf_dir):
    """The grid search's scores: all windows and quantiles of the default grid."""
    series = src.events(spark, sf_dir).withColumn("dim", F.lit(0))
    return SegmentClusterer(method="spectral").grid_scores(series, [0])


@query(
    "top_clusters",
    f"""WITH {Q.segs(25, LEVEL, True)} SELECT series_id, label, n FROM (SELECT series_id, CAST(seg % 7 AS BIGINT) AS label, count(*) AS n FROM mem GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, label) <= 3""",
)
def _(spark, sf_dir):
    series, segs = cut_segments(spark, sf_dir, True)
    return top_labels(S.point_labels(series, segs, F.col("seg") % 7), 3)


# --- generators ----------------------------------------------------------------


def _uniform(*parts: str) -> str:
    text = " || '-' || ".join(parts)
    return f"((CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE)"


_U = _uniform("'toy'", "t")


@query(
    "gen_toy",
    f"""WITH s AS (SELECT t, t // 260 AS k, t % 260 AS spot FROM range(20 * 250 + 19 * 10) r(t)), m AS (SELECT t, spot >= 250 AS ramp, k % 2 = 0 AS even, spot,
      CASE WHEN k % 2 = 0 THEN 100.0::DOUBLE ELSE 200.0 END AS here, CASE WHEN k % 2 = 0 THEN 200.0::DOUBLE ELSE 100.0 END AS there, {_U} AS u FROM s)
    SELECT t, CASE WHEN ramp THEN 1 WHEN even THEN 0 ELSE 2 END AS state, round(CASE WHEN ramp THEN here + (spot - 250 + 1) / 11.0::DOUBLE * (there - here) ELSE here END
      - 5 / sqrt(2.0::DOUBLE) * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)), 6) AS x FROM m""",
)
def _(spark, sf_dir):
    return rounded(G.toy(spark).select("t", "state", "x"), "x")


_UA = _uniform("'arms'", "kind", "t")


@query(
    "gen_variance_arms",
    f"""WITH s AS (SELECT t, (t // 250) % 2 AS b, kind, shift, widen FROM range(5000) r(t), (VALUES ('mean', 20.0::DOUBLE, 0.0::DOUBLE), ('variance', 0.0, 20 / sqrt(2.0::DOUBLE)), ('both', 20 / sqrt(2.0::DOUBLE), 10.0)) k(kind, shift, widen)),
    u AS (SELECT *, {_UA} AS u FROM s) SELECT kind, t, round(b * shift - (5 + b * widen) * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)), 6) AS x FROM u""",
)
def _(spark, sf_dir):
    return rounded(G.variance_arms(spark), "x")


_UI = _uniform("'imbalanced'", "t")


@query(
    "gen_imbalanced",
    f"""WITH s AS (SELECT t, (t // 200) % 4 AS k, {_UI} AS u FROM range(6600) r(t)) SELECT t, CASE k WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS label,
    round(CASE k WHEN 1 THEN 12.0::DOUBLE WHEN 3 THEN 36.0 ELSE 0.0 END - 15 * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)), 6) AS x FROM s""",
)
def _(spark, sf_dir):
    return rounded(G.imbalanced(spark), "x")


def _normal(seed: str, a: int, b: int) -> str:
    return f"sqrt(-2 * ln({_uniform(f"'{seed}'", f"'{a}'", 't')})) * cos({_uniform(f"'{seed}'", f"'{b}'", 't')} * 6.283185307179586::DOUBLE)"


@query(
    "gen_correlation_flip",
    f"""WITH s AS (SELECT t, {_normal('flip', 1, 2)} AS a, {_normal('flip', 3, 4)} AS b FROM range(2000) r(t))
    SELECT t, round(a, 6) AS x1, round(CASE WHEN t < 1000 THEN -0.85::DOUBLE ELSE 0.85 END * a + sqrt(1 - 0.85::DOUBLE * 0.85::DOUBLE) * b, 6) AS x2 FROM s""",
)
def _(spark, sf_dir):
    return rounded(G.correlation_flip(spark), "x1", "x2")


@query(
    "gen_copula_flip",
    f"""WITH s AS (SELECT t, {_normal('copula', 1, 2)} AS a, {_normal('copula', 3, 4)} AS b, {_uniform("'copula'", "'5'", 't')} AS u FROM range(2000) r(t))
    SELECT t, round(a, 6) AS x1, round(CASE WHEN t < 1000 THEN b WHEN u < 0.5 THEN -a ELSE a END, 6) AS x2 FROM s""",
)
def _(spark, sf_dir):
    return rounded(G.copula_flip(spark), "x1", "x2")


@query("gen_two_regimes", f"WITH s AS (SELECT t, {_normal('regimes', 1, 2)} AS z FROM range(10000) r(t)) SELECT t, round(CASE WHEN t < 5000 THEN 0.85::DOUBLE * z ELSE 0.75::DOUBLE * z + 1 END, 6) AS x FROM s")
def _(spark, sf_dir):
    return rounded(G.two_regimes(spark), "x")


@query("toy_detection_scores")
def _(spark, sf_dir):
    """The sweep's core on generated trajectories: statistic, cutoff, change points and their tolerance curve by width."""
    from ..operators import thresholds as T

    parts = []
    for width in (5, 10, 25):
        rows = G.toy(spark, width=width)
        n = 20 * 250 + 19 * width
        series = rows.select(F.lit(width).alias("series_id"), "t", "x", F.lit(n).cast("long").alias("n"))
        truth = spark.range(19).select(F.lit(width).alias("series_id"), F.explode(F.array(F.col("id") * (250 + width) + 250, (F.col("id") + 1) * (250 + width))).alias("truth"))
        stat = W.metric_derivative(series, 25)
        points = T.change_points(stat, T.quantile_cutoffs(stat, [0.75])).where((F.col("t") > 0) & (F.col("t") < n - 1))
        parts.append(M.tolerance_curve(points.select("series_id", "t"), truth, [5, 10, 25, 50], ["series_id"]))
    return parts[0].union(parts[1]).union(parts[2])
