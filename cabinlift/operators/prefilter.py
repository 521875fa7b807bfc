"""Drop rows that cannot find a partner before they are shuffled to look for one.

The keys of one side are marked in a bitmap of fixed size, held as one number per
64 bits, so it may be broadcast whatever the tables' sizes. A row of the other
side whose bit is not set has no partner; the join behind stays exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: at most BITS / 64 rows of two numbers.
BITS = 1 << 24

_CELL, _BITS = "_cell", "_bits"


def _slot(keys: Sequence[Column]) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit(BITS - 1))


def key_bitmap(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """One row per 64 slots in use; rows with a null key are marked like any other."""
    slot = _slot(keys)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    return df.select(F.shiftright(slot, 6).alias(_CELL), bit.alias(_BITS)).groupBy(_CELL).agg(F.bit_or(_BITS).alias(_BITS))


def hopeful(df: DataFrame, bitmap: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """The rows of ``df`` whose keys may be among those marked; all that are, and a few others by chance."""
    slot = _slot(keys)
    marked = df.withColumn("_slot", slot).join(F.broadcast(bitmap), F.shiftright("_slot", 6) == F.col(_CELL))
    found = F.call_function("getbit", F.col(_BITS), F.col("_slot").bitwiseAND(F.lit(63)).cast("int")) == 1
    return marked.filter(found).drop("_slot", _CELL, _BITS)
