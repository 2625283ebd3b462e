"""A blocked Bloom filter as a table: each key has its bits in one block of 256.

Its size is bounded: more keys than it is made for let more rows pass that an
exact join removes afterwards, and change no result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks at most: 2**17 of 32 bytes are 4 MB.
MOST_BLOCKS = 1 << 17
BITS = 6


def block_count(keys: int) -> int:
    """Blocks for so many keys: about 16 bits a key, a power of two, bounded."""
    return min(MOST_BLOCKS, 1 << max(0, (keys * 16 // 256).bit_length()))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bits_of(key: Column) -> Column:
    """A key's bits in its block, as four longs."""
    other = F.xxhash64(key, F.lit(1))
    places = [F.shiftrightunsigned(other, 8 * k).bitwiseAND(255) for k in range(BITS)]
    one = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int"))
    word = lambda w: reduce(Column.bitwiseOR, [F.when(F.shiftright(p, 6) == w, one(p)).otherwise(F.lit(0).cast("long")) for p in places])
    return F.array(*(word(w) for w in range(4)))


def build(keys: DataFrame, key: Column, blocks: int) -> DataFrame:
    """(_block, _w0.._w3): the filter of the rows' keys; blocks without bits have no row."""
    rows = keys.select(block_of(key, blocks).alias("_block"), bits_of(key).alias("_w"))
    return rows.groupBy("_block").agg(*(F.bit_or(F.col("_w")[k]).alias(f"_w{k}") for k in range(4)))


def passing(rows: DataFrame, key: Column, table: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be in the filter: all that are in it, few others.

    The filter has MOST_BLOCKS rows of five longs at most and is broadcast.
    """
    return rows.withColumns({"_block": block_of(key, blocks), "_bits": bits_of(key)}).join(F.broadcast(table), "_block").filter(_there()).select(rows.columns)


def _there() -> Column:
    return reduce(Column.__and__, [F.col(f"_w{k}").bitwiseAND(F.col("_bits")[k]) == F.col("_bits")[k] for k in range(4)])


def split(rows: DataFrame, key: Column, table: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(the rows whose key may be in the filter, the others, whose key is not)."""
    probed = rows.withColumns({"_block": block_of(key, blocks), "_bits": bits_of(key)}).join(F.broadcast(table), "_block", "left")
    there = F.coalesce(_there(), F.lit(False))
    return probed.filter(there).select(rows.columns), probed.filter(~there).select(rows.columns)
