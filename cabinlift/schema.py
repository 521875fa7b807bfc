"""Keys, column lists and declared schemas."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

AUCTION_KEY = ["carrier_code", "flight_number", "travel_date", "upgrade_type"]

# Hours before departure of the five availability readings, nearest first.
HORIZONS = ["01", "12", "24", "48", "72"]


def per_horizon(prefix: str) -> list[str]:
    return [f"{prefix}_{hours}h" for hours in HORIZONS]


EVENT_LOCAL = per_horizon("event_local_date")
COUNTS = per_horizon("available_count")
SCHEDULE = list(zip(EVENT_LOCAL, COUNTS))

MULTIPLIERS = [
    "multiplier_fare_class",
    "multiplier_loyalty",
    "multiplier_success_history",
    "multiplier_payment_type",
]

# Column lists, order and types of the data contract.
FLIGHT_DEDUP_KEY = [
    "carrier_code", "flight_number", "travel_date_local", "cabin_type",
    "origination", "destination", "booking_fare_class",
]
SNAPSHOT_INPUT_TYPES = {
    "id": "bigint", "partner_id": "int", "conf_num": "string", "offer_status": "string",
    "carrier_code": "string", "flight_number": "string", "travel_date": "timestamp_ntz",
    "item_count": "int", "usd_base_amount": "double", "fare_class": "string",
    "offer_time": "double", **{name: "double" for name in MULTIPLIERS},
    "from_cabin": "string", "upgrade_type": "string",
    "decision_timestamp": "timestamp_ntz", "created": "timestamp_ntz",
    **{name: "timestamp_ntz" for name in EVENT_LOCAL},
    **{name: "int" for name in COUNTS},
}
SNAPSHOT_INPUT = list(SNAPSHOT_INPUT_TYPES)
OFFER_COLUMNS = SNAPSHOT_INPUT[: SNAPSHOT_INPUT.index("created") + 1]
SNAPSHOT_OUTPUT_TYPES = {
    **{name: SNAPSHOT_INPUT_TYPES[name] for name in OFFER_COLUMNS},
    "current_timestamp": "timestamp_ntz",
    "current_available_seats": "int",
    "current_seats_col": "string",
    "snapshot_num": "int",
}
SNAPSHOT_OUTPUT = list(SNAPSHOT_OUTPUT_TYPES)
TRAINING_INPUT_TYPES = {
    "carrier_code": "string", "flight_number": "string", "travel_date": "timestamp_ntz",
    "item_count": "int", "usd_base_amount": "double", "seats_available": "double",
    "fare_class": "string", "offer_time": "double",
    **{name: "double" for name in MULTIPLIERS},
    "upgrade_type": "string",
}
TRAINING_INPUT = list(TRAINING_INPUT_TYPES)
MODEL_FEATURES = [
    "carrier_code", "flight_number", "travel_date", "item_count_grp",
    "usd_base_amount_grp", "usd_base_amount_25%", "usd_base_amount_50%",
    "usd_base_amount_75%", "usd_base_amount_max", "num_offers_grp",
    "seats_available_grp", "fare_class", "offer_time_grp", *MULTIPLIERS,
]
CATEGORICAL_FEATURES = [
    "carrier_code", "flight_number", "item_count_grp", "usd_base_amount_grp",
    "num_offers_grp", "seats_available_grp", "fare_class", "offer_time_grp",
]

_TYPES = {
    "bigint": LongType(), "int": IntegerType(), "double": DoubleType(),
    "string": StringType(), "timestamp_ntz": TimestampNTZType(),
}


def struct(types: dict[str, str]) -> StructType:
    return StructType([StructField(name, _TYPES[kind], True) for name, kind in types.items()])


FLIGHTS = struct({
    "carrier_code": "string", "flight_number": "string", "partner_id": "int",
    "departure_date_utc": "timestamp_ntz", "departure_local_date_time": "timestamp_ntz",
    "utc_diff": "int", "cabin_type": "string", "origination": "string",
    "destination": "string", "booking_fare_class": "string", "equip": "string",
    **{name: "timestamp_ntz" for name in per_horizon("event_date")},
    **{name: "timestamp_ntz" for name in per_horizon("update_time")},
    **{name: "int" for name in COUNTS},
})
OFFERS = struct({
    "id": "bigint", "partner_id": "int", "conf_num": "string", "offer_status": "string",
    "operating_carrier": "string", "operating_flight_num": "string",
    "travel_dt": "string", "dep_tm": "string", "from_cabin": "string",
    "upgrade_type": "string", "item_count": "int", "fare_class": "string",
    "base_amount": "double", "inverse_rate": "double", "created": "timestamp_ntz",
    "upgrade_timestamp": "timestamp_ntz", "expiration_timestamp": "timestamp_ntz",
    "instant_upgrade": "int", **{name: "double" for name in MULTIPLIERS},
})
ENRICHED_SNAPSHOT = struct(SNAPSHOT_INPUT_TYPES)
TRAINING = struct(TRAINING_INPUT_TYPES | {"offer_status": "string"})
SNAPSHOTS = struct(SNAPSHOT_OUTPUT_TYPES)
SCORED = struct({"id": "bigint", "label": "int", "score": "double"})
