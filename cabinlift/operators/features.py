"""Binned features and the feature pipeline of the acceptance model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cabinlift import schema as S
from cabinlift.functions import numbers
from cabinlift.operators import groups, hot

# Amounts go in steps, open below the first and above the last.
AMOUNT_STEP, AMOUNT_LAST = 100, 1700
OFFER_DAYS = 30
ITEM_CAP = 4
OFFERS_CAP = 15
SEATS_LOW, SEATS_HIGH, SEATS_MISSING = -1, 30, -2


def amount_bins(df: DataFrame) -> DataFrame:
    """The step an amount lies in, named by its ends; the upper end belongs to it. Null stays null."""
    amount = F.col("usd_base_amount")
    upper = F.ceil(amount / AMOUNT_STEP) * AMOUNT_STEP
    name = (
        F.when(amount.isNull() | F.isnan(amount), None)
        .when(amount <= AMOUNT_STEP, F.lit(f"<{AMOUNT_STEP}"))
        .when(amount > AMOUNT_LAST, F.lit(f">{AMOUNT_LAST}"))
        .otherwise(F.concat((upper - AMOUNT_STEP).cast("string"), F.lit("-"), upper.cast("string")))
    )
    return df.withColumn("usd_base_amount_grp", name)


def offer_time_bins(df: DataFrame) -> DataFrame:
    """Whole days, rounded up; 31 past 30 days, null at or below zero."""
    age = F.col("offer_time")
    bins = F.when(age > OFFER_DAYS, OFFER_DAYS + 1).when(age > 0, F.ceil(age))
    return df.withColumn("offer_time_grp", bins.cast("int"))


def capped_counts(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "item_count_grp": numbers.capped(F.col("item_count"), ITEM_CAP),
        "num_offers_grp": numbers.capped(F.col("num_offers"), OFFERS_CAP),
    })


def seats_bins(df: DataFrame) -> DataFrame:
    seats = numbers.clamped(F.col("seats_available"), SEATS_LOW, SEATS_HIGH, SEATS_MISSING)
    return df.withColumn("seats_available_grp", seats)


def bin_features(df: DataFrame) -> DataFrame:
    return seats_bins(capped_counts(offer_time_bins(amount_bins(df))))


def multiplier_defaults(df: DataFrame) -> DataFrame:
    return df.fillna({name: 1.0 for name in S.MULTIPLIERS})


def with_label(df: DataFrame) -> DataFrame:
    """1 for a ticketed offer, else 0 (also when the state is missing)."""
    return df.withColumn("label", F.coalesce(F.col("offer_status") == "TICKETED", F.lit(False)).cast("int"))


def model_features(
    df: DataFrame,
    keep: list[str] = [],
    heavy_rows: int = hot.HEAVY_ROWS,
    blocks: int | None = None,
) -> DataFrame:
    """Group statistics, bins and leave-one-out quantiles: the model's columns.

    ``keep`` names further columns to carry along. Ordinary auctions take one
    shuffle for all group features.
    """
    df = df.dropna(subset=S.AUCTION_KEY)
    heavy = hot.heavy_groups(df, S.AUCTION_KEY, heavy_rows)

    def side(some: DataFrame, large: bool) -> DataFrame:
        return groups.loo_quantiles_side(groups.group_stats_side(some, large), large, blocks=blocks)

    featured = bin_features(hot.by_side(df, S.AUCTION_KEY, heavy, side))
    return featured.select(*keep, *[name for name in S.MODEL_FEATURES if name not in keep])


def with_split(df: DataFrame, test_from: str) -> DataFrame:
    """Mark rows before ``test_from`` as train and the others as test.

    Rows without a date are in neither.
    """
    boundary = F.lit(test_from).cast("timestamp_ntz")
    part = F.when(F.col("travel_date") < boundary, "train").otherwise("test")
    return df.dropna(subset=["travel_date"]).withColumn("split", part)


def split_summary(df: DataFrame, test_from: str) -> DataFrame:
    """Rows and ticketed rows of each part, with the feature counts."""
    return (
        with_split(with_label(df), test_from)
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_ticketed"))
        .withColumns({
            "n_features": F.lit(len(S.MODEL_FEATURES)),
            "n_categorical": F.lit(len(S.CATEGORICAL_FEATURES)),
        })
    )


def class_weights(df: DataFrame) -> DataFrame:
    """Largest class size over own class size, per label."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    top = counts.agg(F.max("n_rows")).scalar()
    return counts.withColumn("class_weight", top.cast("double") / F.col("n_rows"))
