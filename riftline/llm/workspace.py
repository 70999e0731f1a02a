"""Places and tables that outlive a lost executor.

Lineage is cut by writing Parquet to the folder the cluster names in
``spark.checkpoint.dir``; only a local master may fall back on a folder of its
own.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI. Raises on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="riftline-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/riftline/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one operator; ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self._written = spark, []

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._written.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            for path in [p for f, p in self._written if f is frame]:
                discard(self.spark, path)
        self._written = [(f, p) for f, p in self._written if not any(f is x for x in frames)]

    def clear(self) -> None:
        self.drop(*[f for f, _ in self._written])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` in a written table with one more column, and its name: a number unique whatever the others hold, the same each time it is read."""
    spark = df.sparkSession
    path, row = new_path(spark, label), fresh(df, "_row_key")
    df = df.withColumn(row, F.monotonically_increasing_id())
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), row


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done: its cleaner waits for the driver's garbage collector.

    The events that tell of a plan's end hold it a little longer than the call that ran it.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.25)


def parallelism(spark: SparkSession) -> int:
    """Partitions for explicit range partitioning: as many as the session shuffles into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
