"""Offers joined to flights, with derived times, amounts and visible seats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cabinlift import schema as S
from cabinlift.functions import asof, numbers, times
from cabinlift.operators import hot, prefilter, hygiene

# Offer states kept and cabin names, before and after the join.
KEPT_STATUS = ["TICKETED", "EXPIRED"]
REGIONAL_CABINS = {
    "REGIONAL_PREMIUM_ECONOMY": "PREMIUM_ECONOMY",
    "REGIONAL_BUSINESS": "BUSINESS",
}
SHORT_CABINS = {"PREMIUM_ECONOMY": "P-ECON", "ECONOMY": "ECON", "BUSINESS": "BUS"}
CABIN_COLUMNS = ["from_cabin", "upgrade_type"]

# Most flight rows of heavy keys that are broadcast.
BROADCAST_ROWS = 100_000

# Offer column -> flight column.
FLIGHT_JOIN = {
    "carrier_code": "carrier_code",
    "flight_number": "flight_number",
    "partner_id": "partner_id",
    "travel_date": "travel_date_local",
    "upgrade_type": "cabin_type",
}
# The part of the join key that is in the auction key too.
FLIGHT_DAY = ["carrier_code", "flight_number", "travel_date"]


def typed_flights(flights: DataFrame) -> DataFrame:
    """Add the UTC month and the UTC and local travel days."""
    return flights.withColumns({
        "flight_number": F.col("flight_number").cast("string"),
        "travel_year_month": times.month_start(F.col("departure_date_utc")),
        "travel_date_utc": times.day(F.col("departure_date_utc")),
        "travel_date_local": times.day(F.col("departure_local_date_time")),
    })


def dedup_flights(flights: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """First row per flight, cabin, route and booking class in input order.

    The partner is not part of the key: a second partner's copy is dropped.
    """
    return hygiene.keep_first(flights.drop("equip"), S.FLIGHT_DEDUP_KEY, order)


def typed_offers(offers: DataFrame, strict: bool = True) -> DataFrame:
    """Rename the operating-flight columns, keep settled offers, add calendar parts."""
    settled = (
        offers.withColumnsRenamed({
            "operating_carrier": "carrier_code",
            "operating_flight_num": "flight_number",
        })
        .filter(F.col("offer_status").isin(KEPT_STATUS))
        .withColumns({
            "flight_number": F.col("flight_number").cast("string"),
            "travel_date": times.to_ntz(F.col("travel_dt"), strict),
        })
    )
    date = F.col("travel_date")
    return settled.withColumns({
        "travel_year": F.year(date),
        "travel_month": F.month(date),
        "travel_dow": F.weekday(date),
    })


def plain_cabins(df: DataFrame) -> DataFrame:
    return df.replace(REGIONAL_CABINS, subset=CABIN_COLUMNS)


def short_cabins(df: DataFrame) -> DataFrame:
    return df.replace(SHORT_CABINS, subset=CABIN_COLUMNS)


def join_flights(
    offers: DataFrame,
    flights: DataFrame,
    null_safe: bool = False,
    heavy_rows: int = hot.HEAVY_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
    drop_hopeless: bool = False,
    together: bool = False,
) -> DataFrame:
    """Many-to-many inner join of offers and flights.

    Same-named keys appear once; other clashing names get ``_x`` (offers) and
    ``_y`` (flights). Rows with a null key match only when ``null_safe``.

    Offers of a flight with more than ``heavy_rows`` offers are joined apart.
    The flight rows of those few keys are counted: up to ``broadcast_rows`` they
    are broadcast, so the heavy offers stay where they were read. Beyond that
    the heavy offers are dealt over as many salts as their group needs and the
    flight rows are repeated for each salt. Exact copies of an offer share a
    salt; adaptive skew-join splitting, which cuts by map output, covers those.

    With ``drop_hopeless`` offers without a flight mostly go before the shuffle,
    by a bitmap of the flights' keys; it pays where many have none.

    With ``together`` both sides are dealt by ``FLIGHT_DAY`` if no flight number has
    more than ``heavy_rows`` offers, so that the result of a plan that is written
    ``together`` lies by it.
    """
    if drop_hopeless:
        # As text, so that equal keys of different types have equal bits.
        keys = lambda names: [F.col(name).cast("string") for name in names]
        offers = prefilter.hopeful(
            offers, prefilter.key_bitmap(flights, keys(FLIGHT_JOIN.values())), keys(FLIGHT_JOIN.keys()))
    same_name = [left for left, right in FLIGHT_JOIN.items() if left == right]
    clashes = (set(offers.columns) & set(flights.columns)) - set(same_name)
    left = offers.withColumnsRenamed({name: f"{name}_x" for name in clashes})
    right = flights.withColumnsRenamed(
        {name: f"{name}_y" for name in clashes} | {name: f"_r_{name}" for name in same_name}
    )
    pairs = [
        (f"{a}_x" if a in clashes else a, f"_r_{b}" if b in same_name else f"{b}_y" if b in clashes else b)
        for a, b in FLIGHT_JOIN.items()
    ]
    left_keys = [a for a, _ in pairs]
    def matched(some: DataFrame, other: DataFrame, extra: list[str]) -> DataFrame:
        condition = F.lit(True)
        for a, b in pairs:
            condition = condition & (some[a].eqNullSafe(other[b]) if null_safe else some[a] == other[b])
        for name in extra:
            condition = condition & (some[name] == other[f"_r{name}"])
        return some.join(other, condition).drop(*extra, *[f"_r{name}" for name in extra])

    # The date is parsed from text, so flights of all days are counted first; mostly none has as many offers.
    heavy = None
    together = together and hot.all_below(left, [a for a, b in pairs if a in FLIGHT_DAY[:2]], heavy_rows)
    if together:
        day = [(a, b) for a, b in pairs if a in FLIGHT_DAY]
        left, right = left.repartition(*[a for a, b in day]), right.repartition(*[b for a, b in day])
    elif not hot.all_below(left, [a for a, b in pairs if a != "travel_date"], heavy_rows):
        if not null_safe:
            left = left.dropna(subset=left_keys)
        heavy = hot.heavy_groups(left, left_keys, heavy_rows, stored=False)

    def side(some: DataFrame, large: bool) -> DataFrame:
        if not large:
            return matched(some, right, [])
        salts = F.ceil(F.col(hot.GROUP_ROWS) / F.lit(heavy_rows)).cast("int")
        sizes = hot.sized(heavy.select(
            *[F.col(a).alias(f"_h_{a}") for a in left_keys], salts.alias("_salts")
        ))
        on_left, on_right = F.lit(True), F.lit(True)
        for a, b in pairs:
            on_left = on_left & some[a].eqNullSafe(sizes[f"_h_{a}"])
            on_right = on_right & right[b].eqNullSafe(sizes[f"_h_{a}"])
        few = right.join(sizes, on_right)
        if few.limit(broadcast_rows + 1).count() <= broadcast_rows:
            return matched(some, F.broadcast(few.select(*right.columns)), [])
        dealt = some.join(sizes, on_left).select(
            *some.columns,
            F.pmod(F.xxhash64(*some.columns), F.col("_salts")).cast("int").alias("_salt"),
        )
        repeated = few.select(
            *right.columns,
            F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_r_salt"),
        )
        return matched(dealt, repeated, ["_salt"])

    joined = hot.by_side(left, left_keys, heavy, side)
    return joined.drop(*[f"_r_{name}" for name in same_name])


def decision_time(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "decision_timestamp",
        F.coalesce("upgrade_timestamp", "expiration_timestamp").cast(times.NTZ),
    )


def departure_times(df: DataFrame, strict: bool = True) -> DataFrame:
    """Local departure from its date and time texts, and the same in UTC."""
    text = F.concat(F.col("travel_dt"), F.lit(" "), F.col("dep_tm"))
    return df.withColumn("departure_timestamp", times.to_ntz(text, strict)).withColumn(
        "departure_timestamp_utc",
        times.minus_minutes(F.col("departure_timestamp"), F.col("utc_diff")),
    )


def local_event_times(df: DataFrame) -> DataFrame:
    """Move reading and update times from the UTC clock to the departure's local one."""

    def local(name: str) -> Column:
        return times.shifted(
            F.col(name).cast(times.NTZ),
            F.col("departure_date_utc"), F.col("departure_local_date_time"),
        )

    readings = zip(S.per_horizon("event_date"), S.EVENT_LOCAL)
    updates = zip(S.per_horizon("update_time"), S.per_horizon("update_local_time"))
    return df.withColumns({target: local(source) for source, target in [*readings, *updates]})


def offer_age(df: DataFrame) -> DataFrame:
    """Days from the offer to departure, fractional."""
    return df.withColumn(
        "offer_time", times.days_between(F.col("created"), F.col("departure_timestamp"))
    )


def usd_amount(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "usd_base_amount", numbers.round_cents(F.col("base_amount") * F.col("inverse_rate"))
    )


def seats_at_decision(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "seats_available",
        asof.value_before_decision(F.col("decision_timestamp"), S.SCHEDULE),
    )


def enriched_offers(
    flights: DataFrame,
    offers: DataFrame,
    strict: bool = True,
    null_safe: bool = False,
    heavy_rows: int = hot.HEAVY_ROWS,
    drop_hopeless: bool = False,
    together: bool = False,
) -> DataFrame:
    """The whole enrichment: one lazy plan from the two raw tables."""
    first_flights = dedup_flights(typed_flights(flights))
    if "ingest_seq" in first_flights.columns:
        first_flights = first_flights.drop("ingest_seq")
    wanted = plain_cabins(typed_offers(offers, strict)).filter(F.col("instant_upgrade") == 0)
    # What comes from the offer alone and cannot fail is worked out before the join, which then takes it once
    # and without its parts; in the result it stands where it would after the join.
    early = {"decision_timestamp", "usd_base_amount"}
    before = early.isdisjoint(wanted.columns + first_flights.columns)
    if before:
        wanted = wanted.transform(decision_time).transform(usd_amount)
    joined = short_cabins(join_flights(wanted, first_flights, null_safe, heavy_rows, drop_hopeless=drop_hopeless, together=together))
    place = lambda name, make: lambda df: _last(df, name) if before else make(df)
    return (
        joined
        .transform(place("decision_timestamp", decision_time))
        .transform(lambda df: departure_times(df, strict))
        .transform(local_event_times)
        .transform(offer_age)
        .transform(place("usd_base_amount", usd_amount))
        .transform(seats_at_decision)
    )


def _last(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)
