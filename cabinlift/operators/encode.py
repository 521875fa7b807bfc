"""Categories as rates of their label, without showing a row its own label.

Training rows are put in an order; each gets the rate of the earlier rows of its
category. New rows get the rate of all training rows. Both come from counts
alone, so nothing is gathered, and a category of any size is scanned in blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cabinlift.operators import hot

#: Weight and value of what is assumed before any row of a category is seen.
SMOOTHING, PRIOR = 1.0, 0.5

#: Rows per partition of the result, on average.
TASK_ROWS = 250_000

_CATEGORY, _ORDER, _ROWS, _HITS = "_category", "_order", "_rows_before", "_hits_before"


def _rate(rows: Column, hits: Column, smoothing: float, prior: float) -> Column:
    return (hits + F.lit(smoothing * prior)) / (rows + F.lit(smoothing))


def _known(category: str) -> Column:
    """The category as text that joins; missing ones are a category of their own."""
    text = F.col(f"`{category}`").cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.lit("+"), text))


def ordered_target_rates(
    df: DataFrame,
    category: str,
    label: str = "label",
    order: Sequence[str | Column] = (),
    out: str | None = None,
    smoothing: float = SMOOTHING,
    prior: float = PRIOR,
    blocks: int | None = None,
) -> DataFrame:
    """Add the smoothed rate of ``label`` over the earlier rows of the same category.

    ``label`` is 0 or 1. ``order`` should identify a row; without it rows come in
    the order of a hash of all columns but the label, where equal rows share a
    place and the label decides, which changes only which of them is first. The
    first row of a category gets the prior. Missing categories count as one
    category. The result is a written table.
    """
    place = list(order) or [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c != label])]
    place = [F.col(c) if isinstance(c, str) else c for c in place]
    keyed = df.withColumns({_CATEGORY: _known(category), _ORDER: F.struct(*place, F.col(label))})
    cut = hot.range_blocks(keyed, [_CATEGORY, _ORDER], blocks)
    hit = F.col(label).cast("bigint")
    summary = cut.groupBy(_CATEGORY, hot.BLOCK).agg(F.count(F.lit(1)).alias(_ROWS), F.sum(hit).alias(_HITS))
    before = hot.blocks_before(summary, [_CATEGORY], [_ROWS, _HITS])
    earlier = Window.partitionBy(_CATEGORY, hot.BLOCK).orderBy(_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    rows = F.col(_ROWS) + F.count(F.lit(1)).over(earlier)
    hits = F.col(_HITS) + F.coalesce(F.sum(hit).over(earlier), F.lit(0))
    # Partitions by rows: a reader that keeps the rows, as a fit does, holds far more than was shuffled.
    parts = max(cut.sparkSession.sparkContext.defaultParallelism, -(-cut.count() // TASK_ROWS))
    rated = cut.join(hot.sized(before), [_CATEGORY, hot.BLOCK]).repartition(parts, _CATEGORY, hot.BLOCK)
    return rated.select(*[F.col(f"`{c}`") for c in df.columns],
                        _rate(rows, hits, smoothing, prior).alias(out or f"{category}_rate"))


def target_rates(
    df: DataFrame, category: str, label: str = "label", smoothing: float = SMOOTHING, prior: float = PRIOR
) -> DataFrame:
    """category, n_rows, n_hits, rate over all rows; for rows whose label is not known."""
    counts = df.groupBy(F.col(f"`{category}`").cast("string").alias("category")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(label).cast("bigint")).alias("n_hits"))
    return counts.withColumn("rate", _rate(F.col("n_rows"), F.col("n_hits"), smoothing, prior))


def with_target_rates(
    df: DataFrame, rates: DataFrame, category: str, out: str | None = None, prior: float = PRIOR
) -> DataFrame:
    """Add the rate of each row's category; one that ``rates`` does not list gets the prior."""
    lookup = rates.select(_known("category").alias(_CATEGORY), F.col("rate").alias("_rate"))
    joined = df.withColumn(_CATEGORY, _known(category)).join(hot.few(lookup), _CATEGORY, "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns],
                         F.coalesce("_rate", F.lit(prior)).alias(out or f"{category}_rate"))
