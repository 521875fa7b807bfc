"""Row hygiene: exact duplicates, repeated ids, date floor, schedule conflicts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cabinlift.schema import AUCTION_KEY, EVENT_LOCAL


def exact_dedup(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def since(df: DataFrame, column: str, floor: str | None) -> DataFrame:
    if floor is None:
        return df
    return df.filter(F.col(column) >= F.lit(floor).cast("timestamp_ntz"))


def has_key(df: DataFrame, keys: Sequence[str] = AUCTION_KEY) -> DataFrame:
    """Rows without a missing key; tested one by one, which the optimizer drops where a join tests it anyway."""
    numbers = [k for k in keys if df.schema[k].dataType.typeName() in ("float", "double")]  # NaN is missing too
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df.dropna(subset=numbers) if numbers else df


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` per key; further columns break ties.

    A minimum over the packed row combines on the map side, so a key with many
    repeats never gathers in one task.
    """
    rest = [name for name in df.columns if name not in keys and name != order]
    packed = F.min(F.struct(order, *rest)).alias("row")
    return df.groupBy(*keys).agg(packed).select(*keys, "row.*").select(*df.columns)


_HASHES = ["_hash_1", "_hash_2"]


def _row_hashes(columns: Sequence[str]) -> list[Column]:
    """128 bits of hash of a row. A hash passes over nulls, so where they stand is hashed as a bit each."""
    values = [F.col(f"`{name}`") for name in columns]
    nulls = []
    for start in range(0, len(values), 60):
        bits = [F.when(value.isNull(), 1 << place).otherwise(0).cast("bigint") for place, value in enumerate(values[start:start + 60])]
        nulls.append(reduce(Column.__add__, bits))
    return [F.xxhash64(F.lit(seed), *values, *nulls).alias(name) for seed, name in enumerate(_HASHES)]


def unique_by(df: DataFrame, id_column: str, collapse_exact: bool = True, near: Sequence[str] = ()) -> DataFrame:
    """Keep the rows whose id occurs once; rows without an id are kept.

    With ``collapse_exact`` full-row copies count once, so an id survives when
    all its rows are equal: 128 bits of hash of the row have one value. Its row
    is then the minimum of each column; a column that nobody reads is not sent.
    Equal rows always agree; different rows of an id would by a chance of 2^-128.
    Without it, any repeat removes the id. Either way this is a single
    aggregation by id that combines on the map side; copies and repeats never
    travel together.

    ``near`` names columns by which ``df`` is dealt already. With ``collapse_exact``
    rows then stay where they are: only ids and hashes are sent, and what comes back
    is the ids that have several rows. No row may lack one of these columns.
    """
    columns = df.columns
    row = F.struct(*[F.col(f"`{name}`") for name in columns])
    if collapse_exact and near:
        return _unique_in_place(df, id_column, near)
    if collapse_exact:
        # Rows without an id are grouped by their content instead.
        group = [F.col(id_column).alias("_id"), F.when(F.col(id_column).isNull(), row).alias("_own")]
        seen = df.select("*", *_row_hashes(columns))
        kept = seen.groupBy(*group).agg(*[F.min(f"`{name}`").alias(name) for name in columns], *_hash_range())
        return kept.filter(_one_row()).select(*[f"`{name}`" for name in columns])
    single = (
        df.filter(F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("_id"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("row"))
        .filter(F.col("n") == 1)
        .select("row.*")
    )
    return single.unionByName(df.filter(F.col(id_column).isNull()))


def _hash_range() -> list[Column]:
    return [f(name).alias(f"{name}_{f.__name__}") for name in _HASHES for f in (F.min, F.max)]


def _one_row() -> Column:
    return reduce(Column.__and__, [F.col(f"{name}_min") == F.col(f"{name}_max") for name in _HASHES])


def _unique_in_place(df: DataFrame, id_column: str, near: Sequence[str]) -> DataFrame:
    """``unique_by`` of rows that are dealt by ``near``.

    Ids are compared by place, one row per id and place, without hashes where they
    differ there already. ``df`` is read twice; neither reading tests the id for
    being missing, so that both stay alike and what they shuffle is shuffled once.
    """
    kind = df.schema[id_column].dataType
    missing = F.col(id_column).isNull()
    known = F.coalesce(id_column, F.lit("" if kind.typeName() == "string" else 0).cast(kind))
    # Rows without an id are told apart by their content.
    own = F.when(missing, F.concat_ws(" ", *_HASHES)).otherwise("")
    keys = [*[f"_near_{name}" for name in near], "_id", "_own"]
    seen = df.select("*", *_row_hashes(df.columns)).withColumns(
        dict(zip(keys, [*[F.col(name) for name in near], known, own])))
    sent = seen.groupBy(*keys).agg(*_hash_range()).select(
        *keys, *[F.when(_one_row(), F.col(f"{name}_min")).alias(name) for name in _HASHES])
    of_id = Window.partitionBy("_id", "_own")
    differ = [F.coalesce(F.min(name).over(of_id) != F.max(name).over(of_id), F.lit(False)) for name in _HASHES]
    several = reduce(Column.__or__, differ, F.max(F.col(_HASHES[0]).isNull()).over(of_id))
    repeated = sent.withColumn("_several", several).filter("_several").select(*keys)
    kept = seen.join(repeated.hint("shuffle_hash"), keys, "left_anti")
    return kept.select(*[f"`{name}`" for name in df.columns]).distinct()


def repeated_ids(df: DataFrame, id_column: str) -> DataFrame:
    """Ids that occur more than once, with their counts."""
    counts = df.groupBy(id_column).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") > 1) & F.col(id_column).isNotNull())


def unique_offers(
    df: DataFrame, min_travel_date: str | None, collapse_exact: bool = True, near: Sequence[str] = ()
) -> DataFrame:
    """Auction offers from ``min_travel_date`` on, one row per id.

    The date floor looks at a grouped column only, so it may go first and reach
    the scan; equal rows share their date. ``near`` names columns of the auction
    key by which the offers are dealt already.
    """
    floored = since(has_key(df), "travel_date", min_travel_date)
    return unique_by(floored, "id", collapse_exact, near)


def schedule_conflicts(
    df: DataFrame,
    keys: Sequence[str] = AUCTION_KEY,
    schedule: Sequence[str | Column] = EVENT_LOCAL,
) -> DataFrame:
    """Groups whose rows do not share one schedule, with the number of schedules."""
    return (
        df.groupBy(*keys)
        .agg(F.count_distinct(F.struct(*schedule)).alias("n_schedules"))
        .filter(F.col("n_schedules") > 1)
    )
