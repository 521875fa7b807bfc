"""Heavy groups take other plans; the results must not change."""

import pytest
from pyspark.sql import functions as F

from cabinlift import schema as S
from cabinlift.operators import enrich, evaluate, features, groups, hot, snapshots, timeline
from cabinlift.sources import demo
from tests.conftest import SMALL
from tests.support import bag

# Above 3 rows a group counts as heavy; timelines are cut into 5 blocks.
FEW, BLOCKS = 3, 5


def test_fixture_has_heavy_groups(offers):
    heavy = hot.heavy_groups(offers, S.AUCTION_KEY, FEW)
    assert 0 < heavy.count() < offers.select(*S.AUCTION_KEY).distinct().count()


@pytest.mark.parametrize("operator", [timeline.auction_timeline], ids=lambda f: f.__name__)
def test_timeline(offers, operator):
    assert bag(operator(offers)) == bag(operator(offers, heavy_rows=FEW))


@pytest.mark.parametrize(
    "operator",
    [timeline.snapshot_instants, timeline.alive_offers, snapshots.auction_snapshots,
     groups.loo_quantiles, features.model_features],
    ids=lambda f: f.__name__,
)
def test_blocked(offers, operator):
    plain = bag(operator(offers))
    assert plain == bag(operator(offers, heavy_rows=FEW, blocks=BLOCKS))
    assert plain == bag(operator(offers, heavy_rows=1, blocks=3))


def test_group_stats(offers):
    assert bag(groups.group_stats(offers)) == bag(groups.group_stats(offers, heavy_rows=FEW))


@pytest.mark.parametrize("broadcast_rows", [enrich.BROADCAST_ROWS, 0])
@pytest.mark.parametrize("null_safe", [False, True])
def test_flight_join(spark, broadcast_rows, null_safe):
    flights = enrich.dedup_flights(enrich.typed_flights(demo.flights(spark, SMALL)))
    settled = enrich.plain_cabins(enrich.typed_offers(demo.offers(spark, SMALL)))
    settled = settled.withColumn("partner_id", F.when(F.col("id") % 5 > 0, F.col("partner_id")))
    flights = flights.withColumn(
        "partner_id", F.when(F.col("carrier_code") != "K1", F.col("partner_id"))
    )
    columns = ["id", "partner_id", "flight_number", "booking_fare_class", "travel_date_local", "fare_class"]
    plain = enrich.join_flights(settled, flights, null_safe).select(*columns)
    apart = enrich.join_flights(settled, flights, null_safe, 5, broadcast_rows).select(*columns)
    assert bag(plain) == bag(apart)
    assert plain.count() > 0


@pytest.mark.parametrize("table", ["running_counts", "roc_points", "pr_points", "roc_auc"])
@pytest.mark.parametrize("by", [[], ["part"]])
def test_score_blocks(spark, table, by):
    scored = demo.scored(spark, SMALL).withColumn("part", F.col("id") % 3)
    build = getattr(evaluate, table)
    assert bag(build(scored, by, blocks=1)) == bag(build(scored, by, blocks=7))
