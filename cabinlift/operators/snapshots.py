"""Numbered auction snapshots.

Building every (offer, instant) pair only to compare neighbouring sets would
cost far more than the result. The kept instants are found by a sweep instead:

* Offers enter and leave only at timeline times, so all instants between two
  distinct times show the same offers and the same reading. At most one instant
  per distinct time can be new.
* An offer is alive for one unbroken stretch. The set at a time differs from
  the one before exactly if an offer entered or left there, or the reading
  changed. Counting entries and departures per time is enough.

Only the kept snapshots are then joined to the offers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cabinlift import schema as S
from cabinlift.functions import asof, times
from cabinlift.operators import hot
from cabinlift.operators.timeline import HEAVY_AUCTION, join_alive, lead_in, placed_offers

K = S.AUCTION_KEY
AFTER_LAST = {"72h": "earliest", "01h": "nearest"}


def with_seats(df: DataFrame, after_last_reading: str = "72h") -> DataFrame:
    """Add the reading shown at ``current_timestamp``: its name and seats."""
    at = asof.reading_at(F.col("current_timestamp"), S.SCHEDULE, AFTER_LAST[after_last_reading])
    return (
        df.withColumn("_reading", at)
        .withColumn("current_available_seats", asof.reading_value(F.col("_reading"), S.SCHEDULE).cast("int"))
        .withColumn("current_seats_col", asof.reading_name(F.col("_reading"), S.SCHEDULE))
        .drop("_reading")
    )


def turning_points(df: DataFrame, heavy: bool, after_last_reading: str, strict: bool) -> DataFrame:
    """Per auction and distinct time: entries, departures, reading, and whether
    several kinds of event fall on it."""
    placed = placed_offers(df, heavy, strict)
    created, decision, start = F.col("created"), F.col("decision_timestamp"), F.col("start_ts")
    first_instant = times.midpoint(lead_in(start), start)
    enters = (
        F.when(created <= first_instant, lead_in(start))
        .when(created < start, start)
        .otherwise(created)
    )
    lives = F.coalesce(F.col("enters") < decision, F.lit(False)).cast("bigint")

    def point(ts: Column, kind: int, entered: Column | int = 0, left: Column | int = 0) -> Column:
        as_long = lambda x: x if isinstance(x, Column) else F.lit(x).cast("bigint")
        return F.struct(
            ts.alias("ts"), F.lit(kind).alias("kinds"),
            as_long(entered).alias("entered"), as_long(left).alias("left"),
        )

    # One bit per kind of event: several bits on one time mean a zero-length gap.
    points = F.array(
        point(F.when(created >= start, created), 1),
        point(F.col("enters"), 0, entered=F.col("lives")),
        point(decision, 2, left=F.col("lives")),
        *[point(F.col(name), 4 << i) for i, name in enumerate(S.EVENT_LOCAL)],
    )
    reading = asof.reading_at(F.col("p.ts"), S.SCHEDULE, AFTER_LAST[after_last_reading])
    return (
        placed.withColumn("enters", enters).withColumn("lives", lives)
        .select(*K, *S.EVENT_LOCAL, "end_ts", F.explode(points).alias("p"))
        .filter(F.col("p.ts") <= F.col("end_ts"))
        .select(*K, "p.*", reading.alias("reading"))
        .groupBy(*K, "ts")
        .agg(
            (F.bit_count(F.bit_or("kinds")) > 1).alias("repeated"),
            F.sum("entered").alias("entered"), F.sum("left").alias("left"),
            F.max("reading").alias("reading"),
        )
    )


def _kept(alive: Column, previous_reading: Column) -> Column:
    turned = F.col("reading") != previous_reading
    return (alive > 0) & (
        (F.col("entered") > 0) | (F.col("left") > 0) | F.coalesce(turned, F.lit(False))
    )


def _instant(next_ts: Column) -> Column:
    return F.when(F.col("repeated"), F.col("ts")).otherwise(times.midpoint(F.col("ts"), next_ts))


def kept_snapshots(points: DataFrame) -> DataFrame:
    """Kept instants, numbered from 1 per auction; one window key, no extra shuffle."""
    ordered = Window.partitionBy(*K).orderBy("ts")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    alive = F.sum(F.col("entered") - F.col("left")).over(so_far)
    return (
        points.select(
            *K, "ts",
            _kept(alive, F.lag("reading").over(ordered)).alias("kept"),
            _instant(F.lead("ts").over(ordered)).alias("current_timestamp"),
        )
        .filter("kept")
        .select(*K, "current_timestamp", F.row_number().over(ordered).alias("snapshot_num"))
    )


def kept_snapshots_blocked(points: DataFrame, blocks: int | None = None) -> DataFrame:
    """``kept_snapshots`` for auctions whose timeline exceeds a task: scanned in blocks."""
    keys = [*K, hot.BLOCK]
    cut = hot.range_blocks(points, [*K, "ts"], blocks)
    summary = cut.groupBy(*keys).agg(
        F.min("ts").alias("first_ts"),
        F.max(F.struct("ts", "reading"))["reading"].alias("last_reading"),
        F.sum(F.col("entered") - F.col("left")).alias("alive_before"),
    )
    near = summary.select(
        *keys,
        F.lead("first_ts").over(hot.neighbour(K)).alias("following_ts"),
        F.lag("last_reading").over(hot.neighbour(K)).alias("preceding_reading"),
    )
    edges = hot.sized(near.join(hot.blocks_before(summary, K, ["alive_before"]), keys))
    ordered = Window.partitionBy(*keys).orderBy("ts")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    alive = F.col("alive_before") + F.sum(F.col("entered") - F.col("left")).over(so_far)
    kept = (
        cut.join(edges, keys)
        .select(
            *keys, "ts",
            _kept(alive, F.coalesce(F.lag("reading").over(ordered), F.col("preceding_reading"))).alias("kept"),
            _instant(F.coalesce(F.lead("ts").over(ordered), F.col("following_ts"))).alias("current_timestamp"),
        )
        .filter("kept")
        .select(*keys, "current_timestamp", F.row_number().over(ordered).alias("n"))
    )
    counts = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept_before"))
    offsets = hot.sized(hot.blocks_before(counts, K, ["kept_before"]))
    return kept.join(offsets, keys).select(
        *keys, "current_timestamp",
        (F.col("n") + F.col("kept_before")).cast("int").alias("snapshot_num"),
    )


def auction_snapshots(
    offers: DataFrame,
    after_last_reading: str = "72h",
    strict_schedule: bool = False,
    heavy_rows: int = HEAVY_AUCTION,
    blocks: int | None = None,
) -> DataFrame:
    """Who was bidding, and how many seats showed, at each distinct state of an auction.

    ``offers`` has the snapshot-input columns and unique ids; it is read twice
    or more, so pass a written table rather than a long lineage.
    """
    offers = offers.select(*S.SNAPSHOT_INPUT)
    heavy = hot.heavy_groups(offers, K, heavy_rows)

    def side(some: DataFrame, large: bool) -> DataFrame:
        points = turning_points(some, large, after_last_reading, strict_schedule)
        if large:
            return join_alive(some, kept_snapshots_blocked(points, blocks), heavy, heavy_rows)
        return join_alive(some, kept_snapshots(points))

    rows = with_seats(hot.by_side(offers, K, heavy, side), after_last_reading)
    return rows.select(*[F.col(name).cast(kind) for name, kind in S.SNAPSHOT_OUTPUT_TYPES.items()])
