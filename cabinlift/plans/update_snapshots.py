"""Job: bring written snapshots up to date after some offers changed.

    python -m cabinlift.plans.update_snapshots --before OLD_INPUT --input NEW_INPUT --output SNAPSHOTS

Only the auctions that the change can reach are replayed, and only their months
are written again; the files of all other months stay as they are. The result
equals building everything anew from the new input.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cabinlift import schema as S
from cabinlift.functions.times import month_start
from cabinlift.operators import hot, hygiene, snapshots
from cabinlift.plans.build_snapshots import MIN_TRAVEL_DATE
from cabinlift.session import build_session
from cabinlift.sources import tables
from cabinlift.sources.shared import scratch, written


def changed_offers(before: DataFrame, after: DataFrame) -> DataFrame:
    """Id and auction key of the rows that the two tables do not hold equally often.

    One aggregation by id, key and 128 bits of hash of the whole row, so that rows
    are not shuffled in their width. Equal rows always meet; two different rows of
    one id and auction would be taken for equal by a chance of 2^-128.
    """
    columns = [F.col(f"`{c}`") for c in before.columns]
    signed = before.select(*columns, F.lit(-1).alias("_times")).unionByName(
        after.select(*columns, F.lit(1).alias("_times")))
    # A hash passes over nulls, so where they stand is hashed as well.
    content = [part for c in columns for part in (c, c.isNull())]
    hashes = [F.xxhash64(F.lit(seed), *content).alias(f"_hash_{seed}") for seed in (1, 2)]
    group = signed.select("id", *S.AUCTION_KEY, *hashes, "_times").groupBy("id", *S.AUCTION_KEY, "_hash_1", "_hash_2")
    return group.agg(F.sum("_times").alias("_times")).filter(F.col("_times") != 0).select("id", *S.AUCTION_KEY)


def reached_auctions(after: DataFrame, changed: DataFrame) -> DataFrame:
    """Keys of the auctions whose snapshots may differ.

    Those of the changed rows, and those that share an offer id with one: an id
    that occurs once more, or once less, drops or returns elsewhere too.
    """
    ids = hot.sized(changed.select("id").filter(F.col("id").isNotNull()).distinct())
    sharing = after.join(ids, "id", "left_semi").select(*S.AUCTION_KEY)
    return hygiene.has_key(changed.select(*S.AUCTION_KEY).unionByName(sharing)).distinct()


def updated_auctions(
    after: DataFrame, reached: DataFrame, min_travel_date: str | None, collapse_exact_duplicates: bool = True, **flags
) -> DataFrame:
    """The snapshots of the reached auctions, as a whole rebuild from ``after`` has them.

    Whether an id is unique is asked of all rows with the ids of those auctions.
    """
    floored = hygiene.since(hygiene.has_key(after), "travel_date", min_travel_date)
    ids = hot.sized(floored.join(reached, S.AUCTION_KEY, "left_semi").select("id").filter(F.col("id").isNotNull()).distinct())
    without_id = floored.filter(F.col("id").isNull()).join(reached, S.AUCTION_KEY, "left_semi")
    rows = floored.join(ids, "id", "left_semi").select(*floored.columns).unionByName(without_id)
    unique = hygiene.unique_by(rows, "id", collapse_exact_duplicates).join(reached, S.AUCTION_KEY, "left_semi")
    return snapshots.auction_snapshots(written(unique.select(*S.SNAPSHOT_INPUT), "unique-offers"), **flags)


def update(
    spark: SparkSession, before: DataFrame, after: DataFrame, output: str, min_travel_date: str | None = MIN_TRAVEL_DATE, **flags
) -> list[str]:
    """Update the snapshots in ``output`` from those of ``before`` to those of ``after``; the months written again."""
    floored = [hygiene.since(df, "travel_date", min_travel_date) for df in (before, after)]
    changed = written(changed_offers(*floored), "changed")
    if changed.isEmpty():
        return []
    reached = hot.sized(reached_auctions(after, changed))
    month = month_start(F.col("travel_date")).cast("date").alias(tables.MONTH)
    months = [row[0] for row in reached.select(month).distinct().orderBy(tables.MONTH).collect()]
    fresh = updated_auctions(after, reached, min_travel_date, **flags)
    stored = spark.read.parquet(output).filter(F.col(tables.MONTH).isin(months)).select(*S.SNAPSHOT_OUTPUT)
    kept = stored.join(reached, S.AUCTION_KEY, "left_anti").select(*S.SNAPSHOT_OUTPUT)
    # Written aside first: the months to replace are read until then.
    result = written(kept.unionByName(fresh.select(*S.SNAPSHOT_OUTPUT)), "months")
    tables.write_by_month(result, output, only_these_months=True)
    left = {row[0] for row in result.select(month).distinct().collect()}
    for gone in [m for m in months if m not in left]:
        # Nothing is left of this month.
        result.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{output}/{tables.MONTH}={gone}")
    return [str(m) for m in months]


def run(spark: SparkSession, before: str, source: str, output: str, min_travel_date: str | None = MIN_TRAVEL_DATE, **flags) -> list[str]:
    with scratch(spark):
        old, new = (tables.read_snapshot_input(spark, path, False, min_travel_date) for path in (before, source))
        return update(spark, old, new, output, min_travel_date, **flags)


def main() -> None:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("--before", required=True, help="the enriched offers that OUTPUT was built from")
    options.add_argument("--input", required=True, help="the enriched offers as they are now")
    options.add_argument("--output", required=True, help="snapshots by month, as build_snapshots writes them")
    options.add_argument("--min_travel_date", default=MIN_TRAVEL_DATE)
    chosen = options.parse_args()
    spark = build_session("update-snapshots")
    months = run(spark, chosen.before, chosen.input, chosen.output, chosen.min_travel_date)
    print(f"months written again: {', '.join(months) or 'none'}")
    spark.stop()


if __name__ == "__main__":
    main()
