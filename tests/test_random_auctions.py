"""Random small auctions against a plain-Python replay."""

import random
from collections import Counter, defaultdict
from datetime import timedelta

import pyarrow as pa
import pytest

from cabinlift import schema as S
from cabinlift.operators import snapshots, timeline
from tests.support import offer_rows, t

HOUR = timedelta(hours=1)
EVENTS = [f"event_local_date_{h}h" for h in ("72", "48", "24", "12", "01")]
SEATS = [f"available_count_{h}h" for h in ("72", "48", "24", "12", "01")]


NAMES = ["id", "current_timestamp", "current_seats_col", "snapshot_num", "current_available_seats"]


def random_offers(seed: int, auctions: int) -> list[dict]:
    rng, rows, ids = random.Random(seed), [], iter(range(1, 100_000))
    for flight in range(auctions):
        at = sorted(rng.choices(range(40), k=5))
        schedule = {
            name: None if rng.random() < 0.15 else t("2") + hour * HOUR
            for name, hour in zip(EVENTS, at)
        }
        for _ in range(rng.randint(1, 7)):
            # Few distinct times, so that kinds collide and offers end before they begin.
            made = rng.choice([None] + list(range(-50, 45)))
            decided = rng.choice([None] + list(range(-5, 50)))
            rows.append(schedule | {
                "id": next(ids), "flight_number": str(flight),
                "created": None if made is None else t("2") + made * HOUR,
                "decision_timestamp": None if decided is None else t("2") + decided * HOUR,
            })
    return rows


def instants_of(rows):
    """Replay of one auction's clock: midpoints of its ordered, clipped times."""
    decisions = {row["decision_timestamp"] for row in rows} - {None}
    made = {row["created"] for row in rows} - {None}
    readings = [rows[0][name] for name in EVENTS if rows[0][name] is not None]
    if not decisions:
        return []
    start, end = min([*decisions, *readings]), max(decisions)
    clock = [x for x in [*decisions, *made, *readings] if start <= x <= end]
    clock = sorted([start - timedelta(days=2), *clock])
    return [a + (b - a) / 2 for a, b in zip(clock, clock[1:])]


def reading_shown(row, at):
    for i, name in enumerate(EVENTS):
        if row[name] is not None and at < row[name]:
            return SEATS[max(i - 1, 0)]
    return SEATS[0]


def replay(rows):
    """(id, instant, seats column, number) of every snapshot row of one auction."""
    result, before, number = [], None, 0
    for at in instants_of(rows):
        state = sorted(
            (row["id"], reading_shown(row, at)) for row in rows
            if row["created"] is not None and row["decision_timestamp"] is not None
            and row["created"] <= at < row["decision_timestamp"]
        )
        if state and state != before:
            number += 1
            before = state
            result += [(id_, at, column, number) for id_, column in state]
    return result


def by_flight(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row["flight_number"]].append(row)
    return groups.values()


@pytest.fixture(scope="module", params=[1, 2])
def sample(request):
    return random_offers(request.param, 150)


@pytest.mark.parametrize("options", [{}, {"heavy_rows": 2, "blocks": 4}], ids=["plain", "heavy"])
def test_snapshots(spark, sample, options):
    want = Counter(row for rows in by_flight(sample) for row in replay(rows))
    got = snapshots.auction_snapshots(offer_rows(spark, sample), **options).select(
        "id", "current_timestamp", "current_seats_col", "snapshot_num"
    )
    assert Counter(map(tuple, got.collect())) == want


def test_instants(spark, sample):
    want = Counter(
        (rows[0]["flight_number"], at) for rows in by_flight(sample) for at in instants_of(rows)
    )
    got = timeline.snapshot_instants(offer_rows(spark, sample)).select("flight_number", "current_timestamp")
    assert Counter(map(tuple, got.collect())) == want


def test_numbers_have_no_gaps_and_rows_are_alive(spark, sample):
    rows = snapshots.auction_snapshots(offer_rows(spark, sample)).collect()
    numbers = defaultdict(set)
    for row in rows:
        numbers[tuple(row[k] for k in S.AUCTION_KEY)].add(row["snapshot_num"])
        assert row["created"] <= row["current_timestamp"] < row["decision_timestamp"]
    assert all(found == set(range(1, len(found) + 1)) for found in numbers.values())


def test_row_order_and_partitioning_do_not_matter(spark, sample):
    rows = offer_rows(spark, sample)
    shuffled = rows.repartition(7, "created")
    names = ["id", "current_timestamp", "snapshot_num"]
    first, second = (
        Counter(map(tuple, snapshots.auction_snapshots(df).select(*names).collect()))
        for df in (rows, shuffled)
    )
    assert first == second


def test_grouped_map_replay_of_the_whole_table(spark, offers):
    """Every auction of the small data set, replayed one by one in grouped maps."""

    def replayed(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        seats = {row["id"]: row for row in rows}
        found = [(id_, at, column, number, seats[id_][column]) for id_, at, column, number in replay(rows)]
        return pa.Table.from_pylist([dict(zip(NAMES, row)) for row in found], schema=pa.schema(
            list(zip(NAMES, (pa.int64(), pa.timestamp("us"), pa.string(), pa.int32(), pa.int32())))))

    schema = "id long, current_timestamp timestamp_ntz, current_seats_col string, snapshot_num int, current_available_seats int"
    want = offers.select(*S.SNAPSHOT_INPUT).groupBy(*S.AUCTION_KEY).applyInArrow(replayed, schema)
    got = snapshots.auction_snapshots(offers).select(*NAMES)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert got.count() > 5_000
