"""Small helpers shared by the tests."""

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from cabinlift import schema as S


def bag(df: DataFrame) -> Counter:
    """Rows as a multiset, columns in name order, NaN-free."""
    names = sorted(df.columns)
    return Counter(tuple(row) for row in df.select(*[f"`{n}`" for n in names]).collect())


def t(text: str) -> datetime:
    """``'2 12:30'`` is January 2nd 2025, 12:30; days below 1 fall in December."""
    day, _, clock = text.partition(" ")
    hours, minutes = (clock or "0:0").split(":")
    return datetime(2025, 1, 1) + timedelta(days=int(day) - 1, hours=int(hours), minutes=int(minutes))


DEFAULTS = {
    "id": 1, "partner_id": 0, "conf_num": "C", "offer_status": "TICKETED",
    "carrier_code": "K", "flight_number": "1", "travel_date": datetime(2025, 1, 5),
    "item_count": 1, "usd_base_amount": 100.0, "fare_class": "Y", "offer_time": 1.0,
    **{name: 1.0 for name in S.MULTIPLIERS}, "from_cabin": "ECON", "upgrade_type": "BUS",
    "decision_timestamp": t("5"), "created": t("1"),
    "event_local_date_72h": t("2"), "event_local_date_48h": t("3"),
    "event_local_date_24h": t("4"), "event_local_date_12h": t("4 12:00"),
    "event_local_date_01h": t("4 23:00"),
    "available_count_72h": 10, "available_count_48h": 8, "available_count_24h": 6,
    "available_count_12h": 4, "available_count_01h": 2,
}


def offer_rows(spark, rows: list[dict]) -> DataFrame:
    """Snapshot-input rows; unnamed columns take the defaults above."""
    filled = [tuple((DEFAULTS | row)[name] for name in S.SNAPSHOT_INPUT) for row in rows]
    return spark.createDataFrame(filled, S.ENRICHED_SNAPSHOT)
