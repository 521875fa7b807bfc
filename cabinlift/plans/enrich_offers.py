"""Job: join offers to flights and write the enriched offers.

    python -m cabinlift.plans.enrich_offers --flights F --offers O --output OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cabinlift.operators import enrich
from cabinlift.session import build_session
from cabinlift.sources import tables


def run(
    spark: SparkSession, flights: str, offers: str, output: str, strict: bool = True, drop_hopeless: bool = False,
    compression: str | None = None,
) -> None:
    """Write the enriched offers; ``compression`` packs a CSV output."""
    enriched = enrich.enriched_offers(
        tables.read_flights(spark, flights, strict), tables.read_offers(spark, offers, strict), strict,
        drop_hopeless=drop_hopeless,
    )
    if output.endswith(".csv"):
        tables.write_csv(enriched, output, compression)
    else:
        tables.write_by_month(enriched, output)


def main() -> None:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("--flights", required=True)
    options.add_argument("--offers", required=True)
    options.add_argument("--output", required=True, help="folder; CSV if it ends in .csv")
    options.add_argument("--lenient", action="store_true", help="bad values become null")
    options.add_argument("--drop_hopeless", action="store_true",
                         help="drop offers without a flight before the join; pays where many have none")
    options.add_argument("--compression", help="codec of a CSV output, such as gzip")
    chosen = options.parse_args()
    spark = build_session("enrich-offers")
    run(spark, chosen.flights, chosen.offers, chosen.output, not chosen.lenient, chosen.drop_hopeless, chosen.compression)
    spark.stop()


if __name__ == "__main__":
    main()
