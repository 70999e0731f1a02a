"""Hierarchical residual packing of token sequences.

Round 0: every partition packs its pieces by best fit, longest first. A bin that
no other bin could join (its room is below the smallest fill left anywhere) is
emitted. What stays open is merged up a tree: the open bins of ``fan_in``
neighbouring groups are items of the next best-fit round, until one group is
left or nothing is open.

After a best-fit round two bins of one group never fit together, so each group
has at most one bin that is half full or less; every merge uses up such a bin.
So the merges over the whole tree are fewer than the round-0 packs, which bounds
the table that moves bins to their final place; and a round of a group can use
of each fill at most as many bins as packs (at first) or groups (later) meet in
it. More of them than that stay out of the round: it would end the same with
them, and a task holds at most so many bins for each of ``capacity`` fills.

Only lengths take part; texts are tokenized once and never shuffled.

Defined results: null and empty texts hold the end id alone and are packed as
one piece; a document longer than a sequence is cut into full pieces and a last
shorter one; repeated rows and ids are packed as often as they occur; an empty
table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import default_path, encoder, texts_by_size
from .workspace import stage

CAPACITY = 4096
#: Pieces packed together in round 0: bounds a task's memory.
PACK = 200_000
FAN_IN = 16
#: Bits of a bin's number for its place in its pack, and for the pack in its partition; the partition has the rest.
BIN_BITS, PACK_BITS = 22, 20


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: (bin, offset) of each item and the fill of each bin."""
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
    some = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = some >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                some &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, capacity - room
        fills[b] = capacity - room + size
        if room > size:
            rooms[room - size].append(b)
            some |= 1 << (room - size)
    return bins, offsets, np.array(fills, np.int64)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _bin long, _offset long, _fill long"


def cut_and_pack(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Round 0: every piece with its bin, its offset there and the bin's fill."""

    def batches(it):
        from pyspark import TaskContext

        part, encode, packs = TaskContext.get().partitionId(), encoder(tokenizer_path).encode, 0
        held, count = [], 0

        def flush():
            names = list(held[0])
            cols = {k: pa.concat_arrays([h[k] for h in held]) if k == "doc_id" else np.concatenate([h[k] for h in held]) for k in names}
            bins, offsets, fills = best_fit(cols["length"], capacity)
            if len(fills) >> BIN_BITS or packs >> PACK_BITS or part >> (63 - BIN_BITS - PACK_BITS):
                raise ValueError("too many sequences, packs or partitions for the numbers of bins")
            cols |= {"_bin": ((part << PACK_BITS | packs) << BIN_BITS) | bins, "_offset": offsets, "_fill": fills[bins]}
            return pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], list(cols))

        for batch in it:
            for first, texts in texts_by_size(batch.column(1)):
                ids, lengths = encode(texts)
                ids = ids.astype("<u4")
                data = memoryview(ids).cast("B")
                n = -(-lengths // capacity)
                row = np.repeat(np.arange(len(texts)), n)
                piece = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                start = piece * capacity
                size = np.minimum(lengths[row] - start, capacity)
                at = (np.cumsum(lengths) - lengths)[row] + start
                crc = np.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + size).tolist())], np.int64)
                held.append({"doc_id": batch.column(0).slice(first, len(texts)).take(pa.array(row)), "piece": piece.astype(np.int32), "start": start, "length": size, "ids_crc32": crc})
                count += len(row)
                if count >= PACK:
                    yield flush()
                    held, count, packs = [], 0, packs + 1
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(batches, PIECES)


def merge_open(bins: DataFrame, capacity: int, fan_in: int) -> DataFrame:
    """Where bins of round 0 end up: _bin, _root, _shift."""
    # _bin: a bin of round 0; _root, _shift: where it is now; _group: first its partition
    live = bins.select("_bin", F.col("_bin").alias("_root"), F.lit(0).cast("long").alias("_shift"), "_fill", F.shiftright("_bin", BIN_BITS + PACK_BITS).alias("_group"))
    low, high = 0, 1
    packs = live.agg(F.max(F.shiftright("_bin", BIN_BITS).bitwiseAND(F.lit((1 << PACK_BITS) - 1)))).first()[0]
    half_full = fan_in * ((packs or 0) + 1)  # bins that are half full or less in a group of this round, at most
    while low < high:
        least, low, high = live.agg(F.min("_fill"), F.min("_group"), F.max("_group")).first()
        if least is None:
            break
        live = live.withColumn("_group", F.floor(F.col("_group") / fan_in).cast("long"))
        low, high = low // fan_in, high // fan_in
        # A bin too full for the smallest one left takes no further part; the table keeps it, as others may be in it.
        open_bins = live.where(F.col("_bin") == F.col("_root")).where(F.col("_fill") + F.lit(least) <= capacity)
        alike = F.row_number().over(Window.partitionBy("_group", "_fill").orderBy("_root"))
        open_bins = open_bins.withColumn("_k", alike).where(F.col("_k") <= half_full)
        half_full = fan_in

        def fit(table):
            roots, fills = table.column("_root").to_numpy(), table.column("_fill").to_numpy()
            order = np.argsort(roots, kind="stable")
            roots, fills = roots[order], fills[order]
            where, offsets, sums = best_fit(fills, capacity)
            # a bin's root is the item at its offset 0
            root = np.zeros(len(sums), np.int64)
            root[where[offsets == 0]] = roots[offsets == 0]
            return pa.table({"_was": roots, "_now": root[where], "_more": offsets, "_sum": sums[where]})

        moved = open_bins.select("_group", "_root", "_fill").groupBy("_group").applyInArrow(fit, "_was long, _now long, _more long, _sum long")
        joined = live.join(moved, F.col("_root") == F.col("_was"), "left")
        live = stage(
            joined.select(
                "_bin",
                F.coalesce("_now", "_root").alias("_root"),
                (F.col("_shift") + F.coalesce("_more", F.lit(0))).alias("_shift"),
                F.coalesce("_sum", "_fill").alias("_fill"),
                "_group",
            ),
            "pack-round",
        )
    return live.select("_bin", "_root", "_shift")


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, fan_in: int = FAN_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    pieces = stage(cut_and_pack(docs, tokenizer_path or default_path(), capacity, id_col, text_col), "pack-pieces")
    out = [F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    bins = pieces.where("_offset = 0").select("_bin", "_fill")
    least = bins.agg(F.min("_fill")).first()[0]
    if least is None:
        return pieces.select(*out, F.col("_bin").alias("sequence_id"), F.col("_offset").alias("offset"))
    moves = merge_open(stage(bins.where(F.col("_fill") + F.lit(least) <= capacity), "pack-open"), capacity, fan_in)
    moves = moves.where("_bin <> _root or _shift <> 0")
    # Fewer merges than round-0 packs: the table is small at any size, and Spark checks before it broadcasts.
    placed = pieces.join(moves, "_bin", "left")
    return placed.select(*out, F.coalesce("_root", "_bin").alias("sequence_id"), (F.col("_offset") + F.coalesce("_shift", F.lit(0))).alias("offset"))


QUERY = "op3_residual_packing"
ORACLE = None


def query(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
