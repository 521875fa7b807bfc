"""Auction timelines, their instants, and the offers alive at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cabinlift.functions import times
from cabinlift.operators import hot
from cabinlift.schema import AUCTION_KEY, EVENT_LOCAL

K = AUCTION_KEY
LEAD_IN_DAYS = 2
# Offers of one auction beyond which its pairs with instants are spread over
# tasks. Pairs grow with the square of the offers, so this is far below the
# number of rows a task can hold.
HEAVY_AUCTION = 10_000


def lead_in(start: Column) -> Column:
    return F.timestamp_add("DAY", F.lit(-LEAD_IN_DAYS), start)


def auction_bounds(df: DataFrame) -> DataFrame:
    """Start, end and schedule of every auction that has a decision.

    The start is the earliest time that is not a creation time, the end the last
    decision. ``one_schedule`` is false where the rows disagree on the readings'
    times. Combines on the map side.
    """
    schedule = F.struct(*EVENT_LOCAL)
    return (
        df.dropna(subset=K)
        .groupBy(*K)
        .agg(
            F.min(F.least("decision_timestamp", *EVENT_LOCAL)).alias("start_ts"),
            F.max("decision_timestamp").alias("end_ts"),
            F.min(schedule).alias("schedule"),
            F.max(schedule).alias("_other"),
        )
        .filter(F.col("end_ts").isNotNull())
        .select(
            *K, "start_ts", "end_ts", "schedule.*",
            F.col("schedule").eqNullSafe(F.col("_other")).alias("one_schedule"),
        )
    )


def _usable(df: DataFrame, strict: bool) -> DataFrame:
    """Leave out auctions with several schedules, or raise when ``strict``."""
    if strict:
        message = F.concat_ws(" ", F.lit("more than one schedule in auction"), *[F.col(k).cast("string") for k in K])
        df = df.withColumn(
            "one_schedule", F.when(F.col("one_schedule"), True).otherwise(F.raise_error(message))
        )
    return df.filter("one_schedule").drop("one_schedule")


def placed_offers(df: DataFrame, heavy: bool, strict: bool = False) -> DataFrame:
    """Times of every offer with its auction's schedule, start and end.

    Ordinary auctions take one shuffle, which the timeline goes on to use.
    """
    if heavy:
        bounds = _usable(auction_bounds(df), strict)
        return hot.attach(df.select(*K, "created", "decision_timestamp"), bounds, K, heavy)
    auction = Window.partitionBy(*K)
    schedule = F.struct(*EVENT_LOCAL)
    bounded = df.dropna(subset=K).select(
        *K, "created", "decision_timestamp", *EVENT_LOCAL,
        F.min(F.least("decision_timestamp", *EVENT_LOCAL)).over(auction).alias("start_ts"),
        F.max("decision_timestamp").over(auction).alias("end_ts"),
        F.min(schedule).over(auction).eqNullSafe(F.max(schedule).over(auction)).alias("one_schedule"),
    )
    return _usable(bounded.filter(F.col("end_ts").isNotNull()), strict)


def _timeline_side(df: DataFrame, heavy: bool) -> DataFrame:
    placed = placed_offers(df, heavy)
    kinds = ["decision_timestamp", "created", *EVENT_LOCAL]
    moments = F.array(
        *[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("ts")) for kind in kinds],
        F.struct(F.lit("start_time").alias("kind"), lead_in(F.col("start_ts")).alias("ts")),
    )
    inside = (F.col("kind") == "start_time") | F.col("ts").between(F.col("start_ts"), F.col("end_ts"))
    return (
        placed.select(*K, "start_ts", "end_ts", F.inline(moments))
        .filter(inside)
        .select(*K, "kind", "ts")
        .dropDuplicates()
    )


def auction_timeline(df: DataFrame, heavy_rows: int = HEAVY_AUCTION) -> DataFrame:
    """Distinct (kind, time) pairs per auction between its bounds, plus the lead-in.

    Equal times of different kinds all stay: they make zero-length gaps.
    """
    heavy = hot.heavy_groups(df, K, heavy_rows)
    return hot.by_side(df, K, heavy, _timeline_side)


def _instants_side(df: DataFrame, heavy: bool, blocks: int | None = None) -> DataFrame:
    timeline = _timeline_side(df, heavy)
    if not heavy:
        ordered = Window.partitionBy(*K).orderBy("ts", "kind")
        return _instants(timeline, F.lead("ts").over(ordered), F.row_number().over(ordered))
    cut = hot.range_blocks(timeline, [*K, "ts", "kind"], blocks)
    summary = cut.groupBy(*K, hot.BLOCK).agg(
        F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("rows")
    )
    following = summary.select(
        *K, hot.BLOCK, F.lead("first_ts").over(hot.neighbour(K)).alias("following_ts")
    )
    before = hot.blocks_before(summary, K, ["rows"])
    edges = hot.sized(following.join(before, [*K, hot.BLOCK]))
    ordered = Window.partitionBy(*K, hot.BLOCK).orderBy("ts", "kind")
    joined = cut.join(edges, [*K, hot.BLOCK])
    return _instants(
        joined,
        F.coalesce(F.lead("ts").over(ordered), F.col("following_ts")),
        F.row_number().over(ordered) + F.col("rows"),
        [hot.BLOCK],
    )


def _instants(df: DataFrame, next_ts: Column, number: Column, keep: list[str] = []) -> DataFrame:
    numbered = df.select(*K, *keep, "ts", next_ts.alias("next_ts"), number.cast("int").alias("instant_num"))
    return numbered.filter(F.col("next_ts").isNotNull()).select(
        *K, *keep, "instant_num",
        times.midpoint(F.col("ts"), F.col("next_ts")).alias("current_timestamp"),
    )


def snapshot_instants(
    df: DataFrame, heavy_rows: int = HEAVY_AUCTION, blocks: int | None = None
) -> DataFrame:
    """Midpoints of consecutive timeline times, numbered from 1 per auction."""
    heavy = hot.heavy_groups(df, K, heavy_rows)
    return hot.by_side(
        df, K, heavy, lambda some, large: _instants_side(some, large, blocks).select(
            *K, "instant_num", "current_timestamp"
        )
    )


def alive(created: Column, decision: Column, at: Column) -> Column:
    return (created <= at) & (at < decision)


def join_alive(
    offers: DataFrame,
    instants: DataFrame,
    heavy: DataFrame | None = None,
    heavy_rows: int = HEAVY_AUCTION,
) -> DataFrame:
    """Offers paired with the instants they are alive at.

    An equi-join on the auction with the time range as residual. For heavy
    auctions (``heavy`` given, ``instants`` with their block) the key is the
    auction, the block and a salt: an offer goes to the blocks its life
    overlaps, and offers of one auction are dealt over salts.
    """
    hit = alive(F.col("created"), F.col("decision_timestamp"), F.col("current_timestamp"))
    if heavy is None:
        return offers.join(instants, K).filter(hit)
    salts = heavy.select(
        *K, F.ceil(F.col(hot.GROUP_ROWS) / F.lit(heavy_rows)).cast("int").alias("_salts")
    )
    spans = (
        instants.groupBy(*K, hot.BLOCK)
        .agg(F.min("current_timestamp").alias("_lo"), F.max("current_timestamp").alias("_hi"))
        .join(salts, K)
    )
    spread = (
        offers.join(hot.sized(spans), K)
        .filter((F.col("created") <= F.col("_hi")) & (F.col("decision_timestamp") > F.col("_lo")))
        .select(
            *offers.columns, hot.BLOCK,
            F.pmod(F.xxhash64(*offers.columns), F.col("_salts")).cast("int").alias("_salt"),
        )
    )
    repeated = instants.join(salts, K).select(
        *instants.columns, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt")
    )
    return spread.join(repeated, [*K, hot.BLOCK, "_salt"]).filter(hit).drop(hot.BLOCK, "_salt")


def alive_offers(
    df: DataFrame, heavy_rows: int = HEAVY_AUCTION, blocks: int | None = None
) -> DataFrame:
    """Every offer at every instant of its auction at which it is alive."""
    heavy = hot.heavy_groups(df, K, heavy_rows)
    return hot.by_side(df, K, heavy, lambda some, large: join_alive(
        some, _instants_side(some, large, blocks), heavy if large else None, heavy_rows
    ))
