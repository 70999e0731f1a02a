"""Balanced contiguous shards from global byte-size prefix sums (native).

Rows are range-partitioned by id, each partition is summed, the partition
totals are prefix-summed, and a row's place in the global byte order is its
partition's start plus a running sum inside the partition. Shard ``k`` holds
the rows whose midpoint lies in the ``k``-th of ``shards`` equal byte ranges,
so each shard's size differs from the ideal by less than the two rows at its
ends.

Only the narrow columns (id, size, checksum) are shuffled: the text never is.
The ranged rows are written once to the shared folder, because the ranges are
sampled and must not be drawn again between the totals and the running sums.

Defined results: a null text has size 1 and crc32 0 (as the empty text); a null
id sorts first; repeated ids are ordered by checksum and size and rows alike in
all three are interchangeable; an empty table gives no rows; with fewer rows
than shards some shards stay empty; other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import parallelism, stage


def ranged(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``df`` in a written table with ``_part``: ranges of ``keys``, in order, each in one partition."""
    out = df.repartitionByRange(parallelism(df.sparkSession), *keys).withColumn("_part", F.spark_partition_id())
    return stage(out, label)


def prefix_sums(parts: DataFrame, order: list[str], sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Exclusive running sums over a table made by ``ranged``.

    ``sums`` maps new column to summed column. ``by`` restarts the sums for each
    value of these columns, which must lead the keys the ranges were made by; a
    hot value then spans many partitions and none of them has to see it whole.
    """
    by = by or []
    totals = parts.groupBy(*by, "_part").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    # One row for each partition (and key at its border): bounded by the partition count.
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums])
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_l_{k}") for k, v in sums.items()])
    cond = [local[c].eqNullSafe(starts[c]) for c in [*by, "_part"]]
    joined = local.join(F.broadcast(starts) if not by else starts, cond)
    return joined.select(*[local[c] for c in parts.columns], *[(F.col(f"_s_{k}") + F.col(f"_l_{k}")).alias(k) for k in sums])


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    parts = ranged(rows, order, "shard-ranges")
    placed = prefix_sums(parts.withColumn("_one", F.lit(1).cast("long")), order, {"start": "size", "row": "_one"})
    total = parts.agg(F.sum("size")).first()[0] or 1  # one number
    # floor of the midpoint's share, in integers: (2 start + size) * shards / (2 total)
    cut = F.expr(f"cast((2 * start + size) * {int(shards)} div {2 * total} as int)")
    placed = placed.withColumn("shard", F.least(cut, F.lit(int(shards) - 1)))
    # Slots count from the first row of the shard: one row for each shard.
    firsts = placed.groupBy("shard").agg(F.min("row").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERY = "op10_byte_prefix_shards"


def query(spark, sf_dir):
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# CRC-32 by its table, which is itself made from the polynomial.
ORACLE = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k:
           CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS t FROM documents
), k AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
           lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))) AS text_crc32
  FROM d, crc_table
), s AS (
  SELECT doc_id, size, text_crc32,
         coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         row_number() OVER (ORDER BY doc_id) - 1 AS row_no, sum(size) OVER () AS total
  FROM k
), c AS (
  SELECT *, least(CAST((2 * start + size) * 16 // (2 * total) AS INTEGER), 15) AS shard FROM s
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(row_no - min(row_no) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM c
"""
