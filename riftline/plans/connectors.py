"""Registered queries of sources and sinks: each writes to the shared folder, reads back, and is held against the table it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import series as src
from ..sources import sinks
from ..staging import new_path
from . import sqltext as Q
from .catalog import query, read

_FOLDER = "series_id=([^/]+)/"


@query("text_series_files", f"WITH {Q.SER} SELECT series_id, t, x, n FROM ser")
def _(spark, sf_dir):
    path = new_path(spark, "text-series")
    sinks.to_text(src.events(spark, sf_dir), path, "x", "t", by="series_id")
    return src.text_series(spark, path, _FOLDER)


@query("text_column_files", f"WITH {Q.SER} SELECT series_id, t, x AS x1, -x AS x2 FROM ser")
def _(spark, sf_dir):
    path = new_path(spark, "text-columns")
    line = F.concat_ws(" ", F.col("t").cast("string"), F.col("x").cast("string"), (-F.col("x")).cast("string"))
    sinks.to_text(src.events(spark, sf_dir).withColumn("line", line), path, "line", "t", by="series_id")
    return src.text_columns(spark, path, drop_first=True, pattern=_FOLDER).select("series_id", "t", F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"))


@query("ordered_text", "SELECT round(l_extendedprice, 2) AS x, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf_dir):
    path = new_path(spark, "text-ordered")
    rows = read(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    sinks.to_text(rows, path, "l_extendedprice", "k", decimals=2)
    return spark.read.text(path).groupBy(F.col("value").cast("double").alias("x")).agg(F.count("*").alias("n"))


@query(
    "discovered_files",
    "SELECT 'sigma_' || s || '_transition_' || l || '.txt' AS name, CAST(s AS INTEGER) AS sigma, CAST(l AS INTEGER) AS transition_length FROM (VALUES (0), (5), (20)) a(s), (VALUES (1), (10)) b(l) WHERE NOT (s = 20 AND l = 10)",
)
def _(spark, sf_dir):
    folder = new_path(spark, "trajectories")
    for s in (0, 5, 20):
        for n in (1, 10):
            sinks.to_file(spark, f"{folder}/sigma_{s}_transition_{n}.txt", "1.5\n")
            if (s, n) != (20, 10):  # one without a sibling
                sinks.to_file(spark, f"{folder}/sigma_{s}_transition_{n}_GroundTruth.txt", "0 1\n")
    sinks.to_file(spark, f"{folder}/notes_GroundTruth.txt", "")
    return src.discover(spark, folder)


@query("ground_truth_file", "SELECT 'a' AS series_id, CAST(k AS BIGINT) AS ramp, CAST(100 + 110 * k AS BIGINT) AS start, CAST(110 + 110 * k AS BIGINT) AS \"end\" FROM range(19) r(k)")
def _(spark, sf_dir):
    path = new_path(spark, "ground-truth")
    ends = [v for k in range(19) for v in (100 + 110 * k, 110 + 110 * k)]
    sinks.to_file(spark, f"{path}/series_id=a/truth.txt", "\n".join(map(str, [0, *ends, 2300])))
    return src.ramps(src.text_series(spark, path, _FOLDER), transition_length=10)


@query("csv_round_trip", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def _(spark, sf_dir):
    path, rows = new_path(spark, "csv"), read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    sinks.to_csv(rows, path)
    return src.optional(spark, path, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


@query("report_table", "SELECT c_mktsegment, printf('%.3f', avg(c_acctbal)) AS mean, CAST(count(*) AS VARCHAR) AS n FROM customer GROUP BY 1")
def _(spark, sf_dir):
    folder = new_path(spark, "report")
    sinks.to_table(read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean"), F.count("*").alias("n")), folder, "means")
    cells = F.split("value", r" \| ")
    lines = spark.read.text(f"{folder}/means.md").where("value like '| %' and value not like '| c_mktsegment %'")
    return lines.select(F.ltrim(F.regexp_replace(cells[0], r"^\| ", "")).alias("c_mktsegment"), cells[1].alias("mean"), F.regexp_replace(cells[2], r" \|$", "").alias("n"))


@query(
    "progress_records",
    """WITH a AS (SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier WHERE s_nationkey < 15), b AS (SELECT s_nationkey, s_suppkey, -s_acctbal FROM supplier WHERE s_nationkey >= 10)
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE s_nationkey >= 15""",
)
def _(spark, sf_dir):
    path, rows = new_path(spark, "progress"), read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    sinks.to_progress(rows.where("s_nationkey < 15"), f"{path}/1", ["s_nationkey"])
    later = rows.where("s_nationkey >= 10").withColumn("s_acctbal", -F.col("s_acctbal"))
    sinks.to_progress(sinks.remaining(later, src.progress_log(spark, f"{path}/*", _SUPPLIER, ["s_suppkey"]), ["s_nationkey"]), f"{path}/2", ["s_nationkey"])
    return src.progress_log(spark, f"{path}/*", _SUPPLIER, ["s_suppkey"])


_SUPPLIER = "struct<s_nationkey:bigint,s_suppkey:bigint,s_acctbal:double>"


@query(
    "append_and_dedupe",
    "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS age FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
)
def _(spark, sf_dir):
    keys = read(spark, sf_dir, "customer").select("c_custkey")
    old, new = (keys.where(f"c_custkey % {k} = 0").withColumn("age", F.lit(age)) for k, age in ((2, "old"), (3, "new")))
    return sinks.merged(old, new, ["c_custkey"])


@query("array_files", f"WITH {Q.SER} SELECT series_id, t, x FROM ser")
def _(spark, sf_dir):
    path = new_path(spark, "arrays")
    sinks.to_arrays(src.events(spark, sf_dir), path, "series_id", "x", "t", chunk=1000)
    return src.arrays(spark, path, chunk=1000)


@query("report_lines", "SELECT line FROM (VALUES ('pairs: ' || (SELECT count(*) FROM orders)), ('mean: ' || (SELECT printf('%.4f', avg(o_totalprice)) FROM orders))) v(line)")
def _(spark, sf_dir):
    path = new_path(spark, "lines")
    found = read(spark, sf_dir, "orders").agg(F.count("*"), F.avg("o_totalprice")).first()  # two numbers
    sinks.to_report({"pairs": found[0], "mean": found[1]}, f"{path}/report.txt", spark)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("optional_inputs", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf_dir):
    schema = "r_regionkey bigint, r_name string"
    there = src.optional(spark, f"{sf_dir}/region.parquet", schema, "parquet")
    return there.unionByName(src.optional(spark, f"{sf_dir}/no-such-table.csv", schema))
