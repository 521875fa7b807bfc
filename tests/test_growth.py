"""What queries store and shuffle grows with what they need, not with the width of the tables."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cabinlift import schema as S
from cabinlift.operators import encode, enrich, hot, hygiene, learn
from cabinlift.plans import build_snapshots, registry, update_snapshots
from cabinlift.sources import demo, shared, tables
from tests.conftest import SMALL
from tests.support import bag, offer_rows


@pytest.mark.parametrize("name", ["date_floor", "repeated_ids", "coerced_rows"])
def test_one_reader_stores_no_table(spark, monkeypatch, name):
    monkeypatch.setattr(demo, "_written", {})
    assert registry.QUERIES[name](spark, SMALL).count() > 0
    assert not demo._written


def test_flights_are_made_in_many_tasks(spark):
    assert demo.raw_flights(spark, SMALL).rdd.getNumPartitions() > 1


def test_packed_csv_is_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PACKED_ROWS", 40)
    rows = spark.range(100).select("id", F.lit('a "b", c').alias("s")).coalesce(1)
    path = str(tmp_path / "rows.csv")
    tables.write_csv(rows, path, "gzip")
    assert len(list(Path(path).glob("*.csv.gz"))) == 3
    got = tables._raw(spark, path).select(F.col("id").cast("long"), "s")
    assert sorted(got.collect()) == sorted(rows.collect())


def test_groups_of_a_plan_are_counted_by_hash(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.when(F.col("id") < 50, "x").alias("s"))
    found = {(r["k"], r["s"], r[hot.GROUP_ROWS]) for r in hot.heavy_groups(df, ["k", "s"], 7, stored=False).collect()}
    assert found == {(0, "x", 8), (1, None, 8)}
    assert hot.heavy_groups(df, ["k", "s"], 8, stored=False) is None


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_coerced_values_are_parsed_in_one_projection(spark):
    plan = plan_of(registry.QUERIES["coerced_rows"](spark, SMALL))
    parsing = [line for line in plan.splitlines() if "as decimal(38,6)" in line]
    assert len(parsing) == 1 and parsing[0].strip(" +-").startswith("Project")


def test_changes_are_found_without_shuffling_whole_rows(spark):
    before = offer_rows(spark, [{"id": 1}])
    plan = plan_of(update_snapshots.changed_offers(before, before))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(keys) == 1 and "conf_num" not in keys[0] and "available_count" not in keys[0]


def test_changes_are_counted_and_nulls_have_a_place(spark):
    moved = {"available_count_24h": None, "available_count_48h": 6}
    before = offer_rows(spark, [{"id": 1}, {"id": 2}, {"id": 2}, {"id": 3, "available_count_48h": None}, {"id": None}, {"id": 5}])
    after = offer_rows(spark, [{"id": 1}, {"id": 2}, {"id": 3, **moved}, {"id": None}, {"id": 5, "conf_num": None}])
    changed = update_snapshots.changed_offers(before, after)
    assert changed.columns == ["id", *S.AUCTION_KEY]
    assert {row["id"] for row in changed.collect()} == {2, 3, 5}
    assert update_snapshots.changed_offers(before, before).isEmpty()


def test_margins_are_made_once(spark, monkeypatch):
    made = []
    rows = [(1, [0.5]), (0, [0.1])]
    counted = F.udf(lambda x: x, "array<double>").asNondeterministic()
    table = spark.createDataFrame(rows, "label int, margins array<double>").withColumn("margins", counted("margins"))
    monkeypatch.setattr(learn, "validation_margins", lambda model, table: table)
    monkeypatch.setattr(learn.ranks, "auc_per_score", lambda df, scores: made.append(plan_of(df)) or df)
    learn.auc_curve(None, table)
    assert "BatchEvalPython" not in made[0]


def test_offers_are_counted_by_flight_before_their_dates_are_parsed(spark, monkeypatch):
    flights = enrich.dedup_flights(enrich.typed_flights(demo.raw_flights(spark, SMALL)))
    offers = enrich.plain_cabins(enrich.typed_offers(demo.raw_offers(spark, SMALL)))
    asked = []
    monkeypatch.setattr(enrich.hot, "heavy_groups", lambda *args, **rest: asked.append(args))
    enrich.join_flights(offers, flights)
    assert not asked
    enrich.join_flights(offers, flights, heavy_rows=5)
    assert len(asked) == 1


def test_groups_are_below_what_some_of_their_keys_count(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.when(F.col("id") < 50, "x").alias("s"))
    assert hot.all_below(df, ["k"], 15) and not hot.all_below(df, ["k"], 14)
    assert hot.all_below(df, ["s"], 50) and not hot.all_below(df, ["s"], 49)


def test_amounts_are_worked_out_before_the_join(spark):
    joined = enrich.enriched_offers(demo.raw_flights(spark, SMALL), demo.raw_offers(spark, SMALL))
    plan = plan_of(joined.select("id", "decision_timestamp", "usd_base_amount"))
    assert plan.index("Join") < plan.index("rint(")
    assert joined.columns[-2:] == ["usd_base_amount", "seats_available"]
    assert joined.columns.index("decision_timestamp") == joined.columns.index("departure_timestamp") - 1


def test_unique_rows_are_sent_once_and_no_wider_than_read(spark):
    rows = offer_rows(spark, [{"id": 1}, {"id": 1}, {"id": 2}])
    plan = plan_of(hygiene.unique_by(rows, "id").select("flight_number"))
    assert "min(flight_number" in plan
    for unwanted in ("min(conf_num", "min(struct(", "max(struct("):
        assert unwanted not in plan


def test_rows_that_differ_by_the_place_of_a_null_are_no_copies(spark):
    one, other = {"available_count_24h": None, "available_count_48h": 6}, {"available_count_24h": 6, "available_count_48h": None}
    rows = offer_rows(spark, [{"id": 1, **one}, {"id": 1, **other}, {"id": 2, **one}, {"id": 2, **one}, {"id": None}, {"id": None},
                              {"id": None, "conf_num": None}])
    got = hygiene.unique_by(rows, "id")
    assert got.columns == rows.columns
    assert bag(got) == bag(offer_rows(spark, [{"id": 2, **one}, {"id": None}, {"id": None, "conf_num": None}]))


def test_keys_that_are_no_number_are_missing(spark):
    rows = spark.createDataFrame([("a", 1.0), (None, 1.0), ("b", None), ("c", float("nan"))], "s string, x double")
    assert [row["s"] for row in hygiene.has_key(rows, ["s", "x"]).collect()] == ["a"]


def test_rates_of_one_reader_store_no_table(spark, monkeypatch):
    monkeypatch.setattr(demo, "_written", {})
    assert registry.QUERIES["target_rates"](spark, SMALL).count() > 0
    assert not demo._written


def test_partitions_of_training_rows_grow_with_the_rows(spark, monkeypatch):
    rows = spark.range(100).select("id", (F.col("id") % 50).cast("string").alias("c"), (F.col("id") % 2).alias("label"))
    whole = bag(encode.ordered_target_rates(rows, "c", order=["id"]))
    monkeypatch.setattr(encode, "TASK_ROWS", 10)
    rated = encode.ordered_target_rates(rows, "c", order=["id"])
    assert rated.rdd.getNumPartitions() == 10
    assert bag(rated) == whole


def shuffle_files(spark) -> int:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    rows = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count()
    setting = dict.fromkeys(shared.TIDY)
    before, settings = shuffle_files(spark), {key: spark.conf.get(key, None) for key in setting}
    shared.written(rows, "counts")
    tables.write_parquet(rows, str(tmp_path / "rows"))
    tables.write_csv(rows, str(tmp_path / "rows.csv"))
    assert not hot.all_below(spark.range(1000), ["id"], 0)
    assert shuffle_files(spark) <= before
    assert settings == {key: spark.conf.get(key, None) for key in setting}


# Copies, ids with other rows in the same and in other places, rows without an id.
PLACED = [{"id": 1}, {"id": 1}, {"id": 2}, {"id": 2, "conf_num": None}, {"id": 3}, {"id": 3, "flight_number": "2"},
          {"id": 4}, {"id": 4}, {"id": 4, "travel_date": None}, {"id": 5, "flight_number": "2"}, {"id": 0},
          {"id": 6}, {"id": 6, "conf_num": None}, {"id": 6, "flight_number": "2"}, {"id": None}, {"id": None},
          {"id": None, "conf_num": None}, {"id": None, "flight_number": "2"}]


def test_ids_are_compared_from_place_to_place(spark):
    rows = hygiene.has_key(offer_rows(spark, PLACED))
    kept = [{"id": 1}, {"id": 4}, {"id": 5, "flight_number": "2"}, {"id": 0}, {"id": None}, {"id": None, "conf_num": None},
            {"id": None, "flight_number": "2"}]
    for dealt in (rows, rows.repartition(*enrich.FLIGHT_DAY)):
        got = hygiene.unique_by(dealt, "id", near=enrich.FLIGHT_DAY)
        assert got.columns == rows.columns
        assert bag(got) == bag(offer_rows(spark, kept)) == bag(hygiene.unique_by(rows, "id"))
    text = rows.withColumn("id", F.concat(F.lit("n"), F.col("id").cast("string")))
    assert bag(hygiene.unique_by(text, "id", near=enrich.FLIGHT_DAY)) == bag(hygiene.unique_by(text, "id"))


def exchanges(df) -> list[str]:
    """What the plan shuffles by, in the plan at hand."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(df))


def test_unique_rows_stay_where_the_join_put_them(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(demo, "_written", {})
    monkeypatch.setattr(demo, "written", lambda df, name, together: plans.append((df, together)) or df)
    demo.unique_offers(spark, SMALL)
    (df, together), = plans
    assert together
    with shared.tidy(spark, **shared.TOGETHER):
        keys = exchanges(df)
    # Of all that is shuffled by id, or by flight and day and more, nothing is as wide as a row.
    assert not [k for k in keys if "conf_num" in k or k.startswith("_near_") and "_id" in k]
    wide = [line for line in plan_of(df).splitlines() if "Exchange" in line and "REPARTITION_BY_COL" in line]
    assert len(wide) == 4  # offers and flights of each of two equal readings


def test_stored_offers_are_dealt_by_flight_and_day_unless_one_has_too_many(spark):
    rows = offer_rows(spark, PLACED)
    whole = bag(hygiene.unique_offers(rows, None))
    for heavy_rows in (2, 1000):
        assert bag(build_snapshots.unique_of_stored(rows, None, heavy_rows=heavy_rows)) == whole
    floored = bag(build_snapshots.unique_of_stored(rows, "2026-01-01"))
    assert not floored
    apart = build_snapshots.unique_of_stored(rows, None, collapse_exact_duplicates=False)
    assert bag(apart) == bag(hygiene.unique_offers(rows, None, False))


def test_training_rows_are_sent_without_what_their_inputs_come_from(spark, offers, monkeypatch):
    sent = []
    rated = encode.ordered_target_rates
    monkeypatch.setattr(encode, "ordered_target_rates", lambda df, *args, **rest: sent.append(df.columns) or rated(df, *args, **rest))
    learn.fit(learn.training_table(offers, demo.TEST_FROM), learn.Params(iterations=1, depth=1))
    assert not {"id", "split", "usd_base_amount_max", "fare_class"} & set(sent[0])


def test_offers_that_are_parsed_are_read_in_one_pass(spark):
    rows = offer_rows(spark, PLACED)
    assert tables.as_declared(rows, S.ENRICHED_SNAPSHOT)
    assert not tables.as_declared(rows.withColumn("item_count", F.col("item_count").cast("string")), S.ENRICHED_SNAPSHOT)
