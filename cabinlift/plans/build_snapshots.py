"""Job: replay every auction and write its numbered snapshots.

    python -m cabinlift.plans.build_snapshots --input IN --output OUT
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cabinlift import schema as S
from cabinlift.operators import enrich, hot, hygiene, snapshots
from cabinlift.operators.timeline import HEAVY_AUCTION
from cabinlift.session import build_session
from cabinlift.sources import tables
from cabinlift.sources.shared import scratch, written

# Fixed value: the default date of the job contract.
MIN_TRAVEL_DATE = "2025-05-01"


def build_snapshots(
    offers: DataFrame,
    min_travel_date: str | None = MIN_TRAVEL_DATE,
    collapse_exact_duplicates: bool = True,
    after_last_reading: str = "72h",
    strict_schedule: bool = False,
    heavy_rows: int = HEAVY_AUCTION,
    strict: bool = False,
) -> DataFrame:
    """Snapshots of the enriched ``offers``; see the operators for the flags."""
    unique = _unique(offers, min_travel_date, collapse_exact_duplicates, strict)
    return snapshots.auction_snapshots(unique, after_last_reading, strict_schedule, heavy_rows)


def _unique(offers: DataFrame, min_travel_date: str | None, collapse_exact_duplicates: bool, strict: bool) -> DataFrame:
    typed = tables.conform(tables.drop_dotted(offers), S.ENRICHED_SNAPSHOT, strict)
    return written(hygiene.unique_offers(typed, min_travel_date, collapse_exact_duplicates), "unique-offers")


def unique_of_stored(
    typed: DataFrame, min_travel_date: str | None, collapse_exact_duplicates: bool = True, heavy_rows: int = hot.HEAVY_ROWS
) -> DataFrame:
    """A written copy of the unique offers of a table that is cheap to read.

    Offers are dealt by flight and day, so that those of an auction lie side by
    side, unless one flight and day has too many for a task.
    """
    near = enrich.FLIGHT_DAY
    floored = hygiene.since(hygiene.has_key(typed), "travel_date", min_travel_date)
    if not collapse_exact_duplicates or not hot.all_below(floored, near, heavy_rows):
        near = []
    dealt = floored.repartition(*near) if near else floored
    unique = hygiene.unique_offers(dealt, min_travel_date, collapse_exact_duplicates, near)
    return written(unique, "unique-offers", together=True)


@dataclass(frozen=True)
class Report:
    """What a run left out: auctions with several schedules, and values made null by column."""

    rejected_auctions: int
    made_null: dict[str, int]


def run(
    spark: SparkSession, source: str, output: str, min_travel_date: str | None,
    collapse_exact_duplicates: bool = True, strict: bool = False, compression: str | None = None, **flags,
) -> Report:
    """Write the snapshots, and beside them what was left out.

    Auctions with several schedules go to ``OUT_rejects`` (key and number of
    schedules). Values that do not parse are counted while the offers are read;
    if there are any, the rows that hold them go to ``OUT_coerced``. ``compression``
    packs CSV outputs.
    """
    with scratch(spark):
        raw = tables.raw_snapshot_input(spark, source, min_travel_date)
        counts = None
        if strict:
            typed = tables.conform(raw, S.ENRICHED_SNAPSHOT)
        else:
            typed, counts = tables.conform_and_count(raw, S.ENRICHED_SNAPSHOT)
            if counts and not collapse_exact_duplicates:
                typed = written(typed, "typed")  # read twice below, counted once
        if tables.as_declared(raw, S.ENRICHED_SNAPSHOT):
            unique = unique_of_stored(typed, min_travel_date, collapse_exact_duplicates)
        else:  # what is parsed is read in one pass, which counts or raises
            unique = written(hygiene.unique_offers(typed, min_travel_date, collapse_exact_duplicates), "unique-offers")
        made_null = {name: n for name, n in (counts.get if counts else {}).items() if n}
        rejects = written(hygiene.schedule_conflicts(unique), "rejects")
        left_out = {"rejects": rejects}
        if made_null:
            left_out["coerced"] = tables.coerced_rows(raw, S.ENRICHED_SNAPSHOT)
        result = snapshots.auction_snapshots(unique, **flags)
        if output.endswith(".csv"):
            tables.write_csv(result, output, compression)
            for name, table in left_out.items():
                flat = table.withColumn("made_null", F.array_join("made_null", " ")) if name == "coerced" else table
                tables.write_csv(flat, f"{output.removesuffix('.csv')}_{name}.csv", compression)
        else:
            tables.write_by_month(result, output)
            for name, table in left_out.items():
                tables.write_parquet(table, f"{output.rstrip('/')}_{name}")
        return Report(rejects.count(), made_null)


def main() -> None:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("--input", required=True)
    options.add_argument("--output", required=True, help="folder; CSV if it ends in .csv")
    options.add_argument("--min_travel_date", default=MIN_TRAVEL_DATE)
    options.add_argument("--keep_duplicates_apart", action="store_true",
                         help="drop an id that has several rows even if they are equal")
    options.add_argument("--after_last_reading", choices=["72h", "01h"], default="72h")
    options.add_argument("--strict", action="store_true", help="fail on values that do not parse instead of making them null")
    options.add_argument("--strict_schedule", action="store_true",
                         help="fail on an auction with several schedules instead of leaving it out")
    options.add_argument("--compression", help="codec of a CSV output, such as gzip")
    chosen = options.parse_args()
    spark = build_session("auction-snapshots")
    report = run(
        spark, chosen.input, chosen.output, chosen.min_travel_date,
        collapse_exact_duplicates=not chosen.keep_duplicates_apart,
        strict=chosen.strict, compression=chosen.compression,
        after_last_reading=chosen.after_last_reading, strict_schedule=chosen.strict_schedule,
    )
    print(f"auctions left out for several schedules: {report.rejected_auctions}")
    for name, n in report.made_null.items():
        print(f"values of {name} that did not parse: {n}")
    spark.stop()


if __name__ == "__main__":
    main()
