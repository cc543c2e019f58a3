"""A one-hash Bloom filter of ids, of bounded size, in plain expressions.

Rows whose id certainly is not in a set pass by a shuffle that the set's rows
need.  The filter is a table of 4 KB bitmaps, at most MAX_BITS in all, so it
can always be broadcast; a set too large for it only lets more rows through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _runtime as rt

BITMAP_BITS = 32_768  # of one bitmap_construct_agg value
BITS_PER_ID = 16
MAX_BITS = 1 << 30  # 128 MB


def _slot(value: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(value, F.lit(-1).cast("long"))), F.lit(bits))


def split(rows: DataFrame, value: Column, ids: DataFrame, column: str, count: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose value may be in ids, rows whose value is not), with rows' columns.

    count is about how many ids there are; it sets the filter's size.
    """
    bits = BITMAP_BITS
    while bits < min(MAX_BITS, count * BITS_PER_ID):
        bits *= 2
    slot = _slot(F.col(column), bits)
    place, mark = rt.unused(rows, "sieve_place", "sieve_bits")
    maps = ids.groupBy((F.floor(slot / BITMAP_BITS)).alias(place)).agg(F.bitmap_construct_agg(slot % BITMAP_BITS).alias(mark))
    own = _slot(value, bits)
    pos = own % BITMAP_BITS
    byte = F.conv(F.hex(F.substring(F.col(mark), (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    tested = rows.join(F.broadcast(maps), F.floor(own / BITMAP_BITS) == maps[place], "left")
    inside = F.coalesce(F.getbit(byte, (pos % 8).cast("int")) == 1, F.lit(False))
    names = [F.col(f"`{c}`") for c in rows.columns]
    return tested.where(inside).select(*names), tested.where(~inside).select(*names)
