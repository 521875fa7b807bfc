"""Per-auction statistics and leave-one-out quantiles, joined back to the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cabinlift.functions.numbers import null_if_nan
from cabinlift.operators import hot
from cabinlift.schema import AUCTION_KEY

QUANTILES = {"usd_base_amount_25%": 0.25, "usd_base_amount_50%": 0.5, "usd_base_amount_75%": 0.75}


def group_stats_side(df: DataFrame, heavy: bool, keys: Sequence[str] = AUCTION_KEY) -> DataFrame:
    stats = {
        "num_offers": lambda: F.count(F.lit(1)).cast("int"),
        "usd_base_amount_max": lambda: F.max("usd_base_amount"),
    }
    df = df.drop(*stats)
    if heavy:
        table = df.groupBy(*keys).agg(*[make().alias(name) for name, make in stats.items()])
        return hot.attach(df, table, keys, heavy)
    group = Window.partitionBy(*keys)
    return df.withColumns({
        "num_offers": F.count(F.lit(1)).over(group).cast("int"),
        "usd_base_amount_max": F.max("usd_base_amount").over(group),
    })


def group_stats(
    df: DataFrame, keys: Sequence[str] = AUCTION_KEY, heavy_rows: int = hot.HEAVY_ROWS
) -> DataFrame:
    """Add the number of offers and the largest amount of each auction.

    Earlier values of the two columns are replaced, so this can be re-run.
    """
    df = df.dropna(subset=list(keys))
    heavy = hot.heavy_groups(df, keys, heavy_rows)
    return hot.by_side(df, keys, heavy, lambda some, large: group_stats_side(some, large, keys))


def _positions(n: Column, q: float) -> tuple[Column, Column]:
    """Lower neighbour's index among the other ``n - 1`` values, and the fraction past it."""
    place = F.lit(q) * (n - 2)
    lower = F.floor(place)
    return lower, place - lower


def _leave_one_out(x: Column, n: Column, q: float, sorted_at: Sequence[Column]) -> Column:
    """Quantile of a group's other values, from the group's own order statistics.

    ``sorted_at`` holds the sorted group at the lower index and the two after
    it. Leaving out a value at or below a position moves that position up by
    one. Which of several equal values is left out cannot matter, so comparing
    values stands in for comparing ranks.
    """
    lower, fraction = _positions(n, q)
    at = lambda i: F.when(x <= sorted_at[i], sorted_at[i + 1]).otherwise(sorted_at[i])
    low = at(0)
    high = F.when(lower + 1 <= n - 2, at(1)).otherwise(low)
    return F.when(n > 1, null_if_nan((1 - fraction) * low + fraction * high))


def _value(name: str) -> Column:
    # Missing values sort last and count, as NaN does.
    return F.coalesce(F.col(name).cast("double"), F.lit(float("nan")))


def loo_quantiles_side(
    df: DataFrame,
    heavy: bool,
    keys: Sequence[str] = AUCTION_KEY,
    value: str = "usd_base_amount",
    quantiles: dict[str, float] = QUANTILES,
    blocks: int | None = None,
) -> DataFrame:
    df = df.drop(*quantiles)
    names = {(q, k): f"_s{i}_{k}" for i, q in enumerate(quantiles.values()) for k in range(3)}
    if heavy:
        ranked = hot.attach(df.withColumn("_x", _value(value)),
                            _order_statistics(df, keys, value, names, blocks), keys, heavy)
    else:
        group = Window.partitionBy(*keys)
        staged = df.withColumn("_x", _value(value)).withColumns({
            "_rank": F.row_number().over(group.orderBy("_x")) - 1,
            "_n": F.count(F.lit(1)).over(group),
        })
        ranked = staged.withColumns({
            name: F.max(F.when(F.col("_rank") == _positions(F.col("_n"), q)[0] + k, F.col("_x"))).over(group)
            for (q, k), name in names.items()
        })
    results = [
        _leave_one_out(F.col("_x"), F.col("_n"), q, [F.col(names[q, k]) for k in range(3)]).alias(out)
        for out, q in quantiles.items()
    ]
    return ranked.select(*df.columns, *results)


def _order_statistics(df, keys, value, names, blocks) -> DataFrame:
    """Size and needed order statistics per group, without gathering a group.

    Equal values are counted first; the distinct ones are scanned in blocks.
    """
    cut = hot.range_blocks(
        df.select(*keys, _value(value).alias("_x")).groupBy(*keys, "_x")
        .agg(F.count(F.lit(1)).alias("_copies")),
        [*keys, "_x"], blocks,
    )
    block_keys = [*keys, hot.BLOCK]
    summary = cut.groupBy(*block_keys).agg(F.sum("_copies").alias("_before"))
    totals = summary.groupBy(*keys).agg(F.sum("_before").alias("_n"))
    offsets = hot.blocks_before(summary, keys, ["_before"]).join(totals, list(keys))
    ordered = Window.partitionBy(*block_keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    covered = cut.join(hot.sized(offsets), block_keys).withColumn(
        "_upto", F.col("_before") + F.sum("_copies").over(ordered)
    )
    picks = []
    for (q, k), name in names.items():
        rank = _positions(F.col("_n"), q)[0] + k
        inside = (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_copies"))
        picks.append(F.max(F.when(inside, F.col("_x"))).alias(name))
    return covered.groupBy(*keys).agg(F.first("_n").alias("_n"), *picks)


def loo_quantiles(
    df: DataFrame,
    keys: Sequence[str] = AUCTION_KEY,
    value: str = "usd_base_amount",
    quantiles: dict[str, float] = QUANTILES,
    heavy_rows: int = hot.HEAVY_ROWS,
    blocks: int | None = None,
) -> DataFrame:
    """Add quantiles of ``value`` over the other rows of each row's group.

    Linear interpolation; null for groups of one row.
    """
    df = df.dropna(subset=list(keys))
    heavy = hot.heavy_groups(df, keys, heavy_rows)
    return hot.by_side(df, keys, heavy, lambda some, large: loo_quantiles_side(
        some, large, keys, value, quantiles, blocks
    ))
