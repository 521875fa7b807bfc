"""Shapes the physical plans must keep."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from cabinlift import schema as S
from cabinlift.operators import enrich, features, hot, hygiene, prefilter, snapshots
from cabinlift.plans import registry
from cabinlift.sources import demo
from tests.conftest import SMALL
from tests.support import bag


@pytest.fixture(scope="module", autouse=True)
def large_tables(spark):
    """Plan as for tables too large to broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan: str) -> int:
    return len(re.findall(r"Exchange (?:hash|range|Single|RoundRobin)", plan))


# Those that route rows through a fitted model or count scores in numpy.
IN_BATCHES = {"auc_per_score", "committed_runs"}
NATIVE = [name for name in registry.QUERIES if not name.startswith("gbt_") and name not in IN_BATCHES]


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_rows_and_no_cross_products(spark, name):
    plan = plan_of(entry_points.queries()[name](spark, SMALL))
    for unwanted in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan


@pytest.mark.parametrize("build, most", [
    (lambda df: hygiene.unique_by(df, "id"), 1),
    (lambda df: features.model_features(df, ["id"]), 1),
    (lambda df: snapshots.auction_snapshots(df), 2),
], ids=["unique_by", "model_features", "auction_snapshots"])
def test_shuffle_count(offers, build, most):
    assert shuffles(plan_of(build(offers))) <= most


@pytest.mark.parametrize("build", [
    lambda df: features.model_features(df, ["id"], heavy_rows=3),
    lambda df: snapshots.auction_snapshots(df, heavy_rows=3),
], ids=["model_features", "auction_snapshots"])
def test_heavy_windows_are_cut_into_blocks(offers, build):
    """Beside the ordinary side, every window over rows includes the block."""
    plan = plan_of(build(offers))
    assert hot.BLOCK in plan
    for unwanted in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan


def test_narrow_scan(spark):
    plan = plan_of(entry_points.queries()["seats_bins"](spark, SMALL))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {part.split(":")[0] for part in schema.split(",")} <= {"id", "seats_available"}


def test_date_floor_reaches_the_scan(spark):
    plan = plan_of(hygiene.since(demo.enriched(spark, SMALL), "travel_date", "2000-01-01").select(*S.AUCTION_KEY))
    assert "GreaterThanOrEqual(travel_date" in plan


def test_hopeless_offers_go_before_the_shuffle(spark):
    flights = enrich.dedup_flights(enrich.typed_flights(demo.raw_flights(spark, SMALL))).filter("carrier_code = 'K1'")
    offers = enrich.plain_cabins(enrich.typed_offers(demo.raw_offers(spark, SMALL)))
    keys = lambda names: [F.col(name).cast("string") for name in names]
    bitmap = prefilter.key_bitmap(flights, keys(enrich.FLIGHT_JOIN.values()))
    kept = prefilter.hopeful(offers, bitmap, keys(enrich.FLIGHT_JOIN))
    assert kept.columns == offers.columns
    matched = enrich.join_flights(offers, flights).select("id").distinct().count()
    assert matched <= kept.count() <= 1.01 * kept.filter("carrier_code = 'K1'").count() < 0.3 * offers.count()
    plan = plan_of(enrich.join_flights(offers, flights, drop_hopeless=True))
    assert plan.index("SortMergeJoin") < plan.index("Exchange hashpartitioning") < plan.index("getbit")
    columns = ["id", "flight_number", "booking_fare_class", "travel_date_local"]
    assert bag(enrich.join_flights(offers, flights, drop_hopeless=True).select(*columns)) == bag(
        enrich.join_flights(offers, flights).select(*columns))
