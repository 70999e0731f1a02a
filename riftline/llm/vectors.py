"""What both vector searches share: shards of vectors, blocks of queries, and their meeting.

Vectors are dealt into shards of about ``shard`` by a hash of their row. Each
shard is indexed once and its index written. Every query is sent to every
shard: that is the stated query set against all rows. A task of a shard reads
its index once and then the shard's queries batch by batch, so an index is moved
once, and a task holds one index and one batch whatever the number of queries.
Each (shard, batch) returns the best k of each of its queries; these are merged
by rank.

A row is told apart by a number of its own, not by its id: rows that repeat an
id are each a query and a candidate, also of each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Scratch, keyed

SHARD = 8192
#: Queries asked of an index at a time.
QUERY_BLOCK = 1024
INDEX = "shard long, index binary"


def usable(vectors: DataFrame, id_col: str, vec_col: str, zero_ok: bool) -> tuple[DataFrame, str]:
    """vec_id, v (array<double>) and a row's number, whose name is returned too, in a written table.

    Without null ids, null or empty vectors and those with null or non-finite
    components; of vectors of several lengths the most frequent length (the
    smallest of equally frequent ones) takes part.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))))
    rows, row = keyed(rows if zero_ok else rows.where(F.exists("v", lambda x: x != 0)), "vector-rows")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return rows.where(F.size("v") == F.lit(lengths.d if lengths else 0)), row


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        few = np.flatnonzero(scores >= cut)
        return few[np.lexsort((ids[few], -scores[few]))][:k]
    return np.lexsort((ids, -scores))[:k]


def search(rows: DataFrame, row: str, queries: DataFrame, build, probe, k: int, score_type: str, shard: int | None = None, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score.

    ``build(ids, rows, matrix) -> bytes``; ``probe(bytes, query rows, matrix) -> (query place, row, id, score)``.
    """
    scratch = Scratch(rows.sparkSession)
    shards, block = max(1, -(-rows.count() // (shard or SHARD))), block or QUERY_BLOCK

    def index(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("vec_id", "ascending"), (row, "ascending")])
        ids, names = table.column("vec_id").to_numpy(), table.column(row).to_numpy()
        x = matrix(table.column("v").combine_chunks())
        return pa.table({"shard": table.column("shard")[:1], "index": pa.array([build(ids, names, x)], pa.binary())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(row, F.lit(11)), F.lit(shards)))
    built = scratch.stage(dealt.groupBy("shard").applyInArrow(index, INDEX), "vector-shards")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.col(row).alias("query"), F.col("vec_id").alias("query_id"), "v", F.lit(None).cast("binary").alias("index"))
    held = built.select("shard", F.lit(-1).cast("long").alias("query"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("v"), "index")

    def units(it):
        """Rows of a shard: its index, then its queries."""
        index, at = None, None
        for batch in it:
            shard_of, query = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            borders = np.flatnonzero(np.diff(shard_of)) + 1
            for lo, hi in zip([0, *borders], [*borders, len(batch)]):
                if query[lo] < 0:
                    index, at, lo = batch.column(4)[lo].as_py(), shard_of[lo], lo + 1
                if at != shard_of[min(lo, len(batch) - 1)] or lo == hi:
                    continue  # a shard without vectors, or without queries here
                for a in range(lo, hi, block):
                    part = batch.slice(a, min(block, hi - a))
                    place, names, ids, scores = probe(index, part.column(1).to_numpy(), matrix(part.column(3)))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(1).take(pa.array(place)), part.column(2).take(pa.array(place)), pa.array(names), pa.array(ids), pa.array(scores)],
                        ["query", "query_id", "row", "vec_id", "score"],
                    )

    both = held.unionByName(asked).repartition(3 * shards, "shard").sortWithinPartitions("shard", "query")
    found = both.mapInArrow(units, f"query long, query_id long, row long, vec_id long, score {score_type}")
    by_query = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
