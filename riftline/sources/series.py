"""Series tables from columns of a table and from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_table(df: DataFrame, series_id, order: list[str], value, bucket=None) -> DataFrame:
    """series_id, t, x, n with ``t`` from 0 in the given order.

    ``bucket`` is a coarse column that never falls along ``order`` (a day, say).
    Rows are then numbered inside (series, bucket), and the counts of the buckets
    before, one row for each bucket, are added: a long series is many tasks.
    """
    rows = df.select(series_id.alias("series_id"), *order, value.alias("x"), (F.lit(0) if bucket is None else bucket).alias("_bucket"))
    counts = rows.groupBy("series_id", "_bucket").agg(F.count("*").alias("_size"))
    by = Window.partitionBy("series_id")
    before = F.sum("_size").over(by.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("series_id", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(by).alias("n"))
    inside = F.row_number().over(Window.partitionBy("series_id", "_bucket").orderBy(*order)) - 1
    rows = rows.withColumn("_k", inside).join(counts, ["series_id", "_bucket"])
    return rows.select("series_id", (F.col("_before") + F.col("_k")).cast("long").alias("t"), "x", "n")


def events(spark: SparkSession, sf_dir: str, value=None) -> DataFrame:
    """A series for each event type, by time and id."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    return from_table(table, F.col("event_type"), ["ts", "event_id"], F.col("value") if value is None else value, F.to_date("ts"))


def name_of(path, pattern: str | None):
    """A file's series: its name, or what the first group of ``pattern`` finds in its path."""
    return F.element_at(F.split(path, "/"), -1) if pattern is None else F.regexp_extract(path, pattern, 1)


def text_series(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Whitespace-separated numbers of whole files, in order: series_id, t, x, n."""
    name = name_of(F.col("_metadata.file_path"), pattern)
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(name.alias("series_id"), F.filter(F.split("value", r"\s+"), lambda s: s != "").alias("v"))
    return files.select("series_id", F.size("v").cast("long").alias("n"), F.posexplode("v").alias("t", "x")).select("series_id", F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x"), "n")


def arrays(spark: SparkSession, path: str, key: str = "series_id", chunk: int = 1 << 20) -> DataFrame:
    """key, t, x from what ``to_arrays`` wrote."""
    rows = spark.read.parquet(path)
    kind = rows.schema[key].dataType.simpleString()

    def unpack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k, part, data in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                x = np.frombuffer(data.as_py(), "<f8")
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(x), k.type), pa.array(np.arange(len(x)) + part * chunk), pa.array(x)], [key, "t", "x"])

    return rows.select(key, "part", "data").mapInArrow(unpack, f"{key} {kind}, t long, x double")


def text_columns(spark: SparkSession, path: str, drop_first: bool = False, pattern: str | None = None) -> DataFrame:
    """Rows of numbers: series_id, t, x (array), without the first column if asked."""
    name = name_of(F.col("_metadata.file_path"), pattern)
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(name.alias("series_id"), F.filter(F.split("value", r"\n"), lambda s: F.trim(s) != "").alias("v"))
    rows = files.select("series_id", F.posexplode("v").alias("t", "line"))
    x = F.transform(F.split(F.trim("line"), r"\s+"), lambda s: s.cast("double"))
    return rows.select("series_id", F.col("t").cast("long").alias("t"), (F.slice(x, 2, F.size(x)) if drop_first else x).alias("x"))


def discover(spark: SparkSession, folder: str, pattern: str = r"^sigma_(\d+)_transition_(\d+)\.txt$", truth: str = "_GroundTruth.txt") -> DataFrame:
    """name, sigma, transition_length of trajectories that have a ground-truth sibling. Files are listed, not read: only their paths are asked for."""
    names = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    found = names.select("name", F.regexp_extract("name", pattern, 1).alias("s"), F.regexp_extract("name", pattern, 2).alias("l")).where("s <> ''")
    known = names.where(F.col("name").endswith(truth)).select(F.regexp_replace("name", truth.replace(".", r"\.") + "$", ".txt").alias("name"))
    return found.join(known, "name", "left_semi").select("name", F.col("s").cast("int").alias("sigma"), F.col("l").cast("int").alias("transition_length")).orderBy("sigma", "transition_length")


def ramps(boundaries: DataFrame, transition_length: int | None = None, expected: int = 19) -> DataFrame:
    """series_id, ramp, start, end from boundary rows (series_id, t, x): pairs (1, 2), (3, 4), ... of an even-length list.

    With ``transition_length`` every width must be within one of it and the widths
    must add up to ``expected`` times it, else the query fails.
    """
    order = Window.partitionBy("series_id").orderBy("t")
    out = boundaries.withColumn("end", F.lead("x").over(order)).where("t % 2 = 1 and end is not null")
    out = out.select("series_id", F.floor((F.col("t") - 1) / 2).cast("long").alias("ramp"), F.col("x").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    if transition_length is None:
        return out
    by = Window.partitionBy("series_id")
    width = F.col("end") - F.col("start")
    good = (F.abs(width - transition_length) <= 1) & (F.sum(width).over(by) == expected * transition_length)
    return out.withColumn("_ok", good).where(F.when(F.col("_ok"), F.lit(True)).otherwise(F.raise_error(F.lit("ramp widths don't fit the transition length")).cast("boolean"))).drop("_ok")


def progress_log(spark: SparkSession, path: str, row_schema: str, keys: list[str]) -> DataFrame:
    """Rows of an append-only JSON-lines log, the first record of each key; broken lines are skipped."""
    text = spark.read.text(path).select(F.monotonically_increasing_id().alias("_line"), F.from_json("value", f"rows array<{row_schema}>").alias("j")).where("j.rows is not null")
    rows = text.select("_line", F.posexplode("j.rows").alias("_place", "r")).select("_line", "_place", "r.*")
    first = Window.partitionBy(*keys).orderBy("_line", "_place")
    return rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "_line", "_place")


def optional(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """A table, or no rows where the path doesn't exist."""
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(conf).exists(where):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if kind == "csv" else reader.format(kind).load(path)
