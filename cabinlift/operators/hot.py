"""Heavy groups: find them, set them apart, and scan them in blocks.

Group-wise operators here are written as ``side(df, heavy)``. Ordinary groups
go through one shuffle on the group key and plain window functions. Groups too
large for one task are set apart, all of them; for those, a table with one
row per group is counted and broadcast only while it is small, else shuffled, and
ordered scans run over range-partitioned blocks whose summaries are combined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cabinlift.sources.shared import tidy, written

# Rows of one group that a single task may hold and sort.
HEAVY_ROWS = 2_000_000
# Rows up to which a table with one row per heavy group or block is broadcast.
# Beyond it the join shuffles both sides, and adaptive execution splits what is
# skewed. The result is the same either way.
BROADCAST_ROWS = 200_000

FEW, MANY = "few", "many"
BLOCK = "_block"
GROUP_ROWS = "_group_rows"


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def heavy_groups(
    df: DataFrame, keys: Sequence[str], heavy_rows: int = HEAVY_ROWS, stored: bool = True
) -> DataFrame | None:
    """The groups above ``heavy_rows`` with their sizes, or None if there are none.

    A table of no more rows has no such group, which a count of rows tells; it
    is not asked of a table that is not ``stored``, where it takes a run of the
    whole plan. Otherwise rows are counted by a hash of their key, which is narrow
    and combines on the map side; a group is no larger than what its hash
    counts, so only the groups of heavy hashes are counted themselves. The list
    is written to the shared folder and may have any length.
    """
    if stored and df.count() <= heavy_rows:
        return None
    hashed = F.xxhash64(*keys).alias("_key_hash")
    many = written(
        df.select(hashed).groupBy("_key_hash").count().filter(F.col("count") > heavy_rows).select("_key_hash"), "heavy-hashes")
    if many.isEmpty():
        return None
    some = df.select(*keys, hashed).join(few(many), "_key_hash", "left_semi")
    sizes = written(
        some.groupBy(*keys).agg(F.count(F.lit(1)).alias(GROUP_ROWS)).filter(F.col(GROUP_ROWS) > heavy_rows), "heavy")
    return None if sizes.isEmpty() else sizes


def all_below(df: DataFrame, keys: Sequence[str], heavy_rows: int) -> bool:
    """Whether no group by ``keys`` has more rows; then no group by these and more keys has either.

    For a plan whose other keys cost much to work out. Counted by hash, with
    missing keys; a hash that counts more tells nothing.
    """
    counts = df.groupBy(F.xxhash64(*keys).alias("_key_hash")).count()
    with tidy(df.sparkSession):
        return counts.filter(F.col("count") > heavy_rows).isEmpty()


def few(table: DataFrame) -> DataFrame:
    """``table``, which is cheap to read, to be broadcast if its rows are few enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def sized(table: DataFrame) -> DataFrame:
    """A written copy of ``table``, to be broadcast if its rows are few enough."""
    return few(written(table, "sized"))


def set_apart(
    df: DataFrame, keys: Sequence[str], heavy: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` into (ordinary, heavy) rows by the heavy keys."""
    marks = heavy.select(*keys)
    if heavy.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    condition = same_key(df, marks, keys)
    return df.join(marks, condition, "left_anti"), df.join(marks, condition, "left_semi")


def by_side(
    df: DataFrame,
    keys: Sequence[str],
    heavy: DataFrame | None,
    side: Callable[[DataFrame, bool], DataFrame],
) -> DataFrame:
    """Apply ``side`` to the ordinary rows and, if any, to the heavy ones.

    ``side`` gets False for ordinary rows; for heavy ones it gets FEW or MANY,
    by how many groups there are.
    """
    if heavy is None:
        return side(df, False)
    ordinary, large = set_apart(df, keys, heavy)
    return side(ordinary, False).unionByName(side(large, FEW if heavy.count() <= BROADCAST_ROWS else MANY))


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], heavy: bool | str) -> DataFrame:
    """Add the columns of a one-row-per-group table to the rows of each group."""
    return df.join(F.broadcast(table) if heavy == FEW else table, list(keys))


def range_blocks(
    df: DataFrame, order: Sequence[str | Column], blocks: int | None = None
) -> DataFrame:
    """Write ``df`` range-partitioned by ``order``, with its partition number in ``_block``.

    ``order`` should identify a row, so that any run of rows can be cut. Later
    windows use ``(group, _block)`` as their key; a block never holds more than
    one range partition.
    """
    cut = df.repartitionByRange(*([blocks] if blocks else []), *order)
    return written(cut.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def blocks_before(
    summary: DataFrame, keys: Sequence[str], totals: Sequence[str]
) -> DataFrame:
    """Turn per-(group, block) totals into totals over the earlier blocks.

    ``summary`` has at most one row per block plus one per group.
    """
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BLOCK).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return summary.select(
        *keys, BLOCK,
        *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in totals],
    )


def neighbour(keys: Sequence[str]):
    """Window over the blocks of a group, for looking at the adjacent summaries."""
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BLOCK)
