"""Writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def to_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def to_jsonl(df: DataFrame, path: str) -> None:
    """Append a batch of results to a log, a record for each row."""
    df.write.mode("append").json(path)


def to_progress(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append a record for each value of ``keys``: its rows as one list, as ``progress_log`` reads them."""
    to_jsonl(df.groupBy(*keys).agg(F.collect_list(F.struct(*df.columns)).alias("rows")).select("rows"), path)  # the rows of one finished setting


def to_text(df: DataFrame, path: str, column: str, order: str, by: str | None = None, decimals: int | None = None) -> None:
    """One value a line, in ``order``: a file in the folder ``by=value`` for each value of ``by``, or part files whose names are in order."""
    value = F.col(column) if decimals is None else F.format_string(f"%.{decimals}f", column)
    lines = df.select(*([by] if by else []), order, value.cast("string").alias("value"))
    if by is None:
        lines.orderBy(order).select("value").write.mode("overwrite").text(path)
    else:
        lines.repartition(by).sortWithinPartitions(by, order).select(by, "value").write.mode("overwrite").partitionBy(by).text(path)


def to_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file of a given name, through the store's own interface."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def report_text(values: dict) -> str:
    """``key: value`` lines, numbers with four decimals."""
    return "".join(f"{k}: {v:.4f}\n" if isinstance(v, float) else f"{k}: {v}\n" for k, v in values.items())


def to_report(values: dict, path: str, spark: SparkSession) -> None:
    to_file(spark, path, report_text(values))


def to_arrays(df: DataFrame, path: str, key: str, column: str, order: str, chunk: int = 1 << 20) -> None:
    """Each key's values as little-endian doubles, a row for each run of ``chunk`` places: key, part, size, data."""
    rows = df.select(key, F.floor(F.col(order) / chunk).alias("part"), F.col(order).alias("_at"), F.col(column).cast("double").alias("_v"))
    kind = df.schema[key].dataType.simpleString()

    def pack(table):
        import pyarrow as pa

        table = table.sort_by("_at")
        values = table.column("_v").to_numpy().astype("<f8")
        return pa.table({key: table.column(key)[:1], "part": table.column("part")[:1], "size": pa.array([len(values)], pa.int64()), "data": pa.array([values.tobytes()], pa.binary())})

    rows.groupBy(key, "part").applyInArrow(pack, f"{key} {kind}, part long, size long, data binary").write.mode("overwrite").parquet(path)


def to_table(df: DataFrame, folder: str, name: str, decimals: int = 3) -> None:
    """A report table twice: CSV in ``name`` and Markdown in ``name.md``."""
    to_csv(df, f"{folder}/{name}", single=True)
    to_file(df.sparkSession, f"{folder}/{name}.md", markdown(df, decimals))


def markdown(df: DataFrame, decimals: int = 3, limit: int = 1000) -> str:
    """A report table as Markdown; reports are small, and longer tables are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    show = lambda v: "" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows]) + "\n"


def merged(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows, one for each key, old ones first."""
    if old is None:
        return new.dropDuplicates(keys)
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy(*keys).orderBy("_age")
    return both.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "_age")


def remaining(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a result yet."""
    return jobs.join(done.select(*keys).distinct(), keys, "left_anti")
