"""A membership filter of a fixed size: a bitmap of hashed keys.

``BITS`` bits, 4 MB, whatever the table; so it may be broadcast. A key of the
table always passes, another one passes with the share of set bits as its
chance: what passes is settled by an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import fresh

BITS = 1 << 25
#: Bits of one row of the filter, as ``bitmap_construct_agg`` makes them.
ROW_BITS = 32_768


def place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(41)), F.lit(BITS))


def with_maybe(rows: DataFrame, key: Column, table: DataFrame, column: str, out: str = "_maybe") -> DataFrame:
    """``rows`` with ``out``: false only where ``key`` isn't among ``table``'s values of ``column``; nulls are a value."""
    at, word, bits = (fresh(rows, f"_bitmap_{c}") for c in ("at", "word", "bits"))
    found = table.select(place(F.col(column)).alias(at)).groupBy(F.floor(F.col(at) / ROW_BITS).alias(word))
    found = found.agg(F.bitmap_construct_agg(F.col(at) % ROW_BITS).alias(bits))
    rows = rows.withColumn(at, place(key)).withColumn(word, F.floor(F.col(at) / ROW_BITS))
    # BITS / ROW_BITS rows of 4 KB at most
    rows = rows.join(F.broadcast(found), word, "left")
    byte = F.conv(F.hex(F.substring(bits, (F.floor((F.col(at) % ROW_BITS) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (F.col(at) % 8).cast("int")) == 1
    return rows.withColumn(out, F.coalesce(is_set, F.lit(False))).drop(at, word, bits)
