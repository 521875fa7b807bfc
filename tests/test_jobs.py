"""Readers, writers and the three jobs end to end."""

import os
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cabinlift import schema as S
from cabinlift.operators import learn, snapshots
from cabinlift.plans import build_snapshots, enrich_offers, train_model, update_snapshots
from cabinlift.sources import demo, runs, shared, tables
from tests.conftest import SMALL
from tests.support import bag, offer_rows


@pytest.fixture(scope="module")
def enriched_csv(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("enrich")
    flights, offers, out = (str(folder / name) for name in ("flights.csv", "offers.csv", "enriched.csv"))
    tables.write_csv(demo.raw_flights(spark, SMALL), flights)
    tables.write_csv(demo.raw_offers(spark, SMALL).withColumn("odd.name", F.lit(1)), offers)
    enrich_offers.run(spark, flights, offers, out)
    return out


def test_enrich_job_equals_operator(spark, enriched_csv):
    got = tables.read_snapshot_input(spark, enriched_csv)
    assert bag(got) == bag(demo.enriched(spark, SMALL).select(*S.SNAPSHOT_INPUT))


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_snapshot_job(spark, enriched_csv, tmp_path, offers, kind):
    out = str(tmp_path / f"snapshots.{kind}")
    build_snapshots.run(spark, enriched_csv, out, demo.SNAPSHOT_FROM)
    got = tables.read_table(spark, out, S.SNAPSHOTS)
    assert got.schema == S.SNAPSHOTS
    assert bag(got) == bag(snapshots.auction_snapshots(offers))


def test_only_the_months_needed_are_read(spark, tmp_path):
    path, source = str(tmp_path / "enriched"), demo.enriched(spark, SMALL)
    tables.write_by_month(source, path)
    late = tables.read_snapshot_input(spark, path, min_travel_date="2000-02-10")
    want = source.filter("travel_date >= timestamp_ntz'2000-02-01'").select(*S.SNAPSHOT_INPUT)
    assert bag(late) == bag(want)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "travel_month_start" in plan[plan.index("PartitionFilters"):]


def test_snapshot_job_flags(spark, enriched_csv):
    source = tables.read_snapshot_input(spark, enriched_csv)
    ids = lambda **flags: build_snapshots.build_snapshots(
        source, demo.SNAPSHOT_FROM, **flags).select("id").distinct().count()
    assert ids(collapse_exact_duplicates=False) < ids()
    assert build_snapshots.build_snapshots(source).count() == 0  # nothing that late


def test_train_job(spark, enriched_csv, tmp_path, offers):
    source, out = str(tmp_path / "training"), str(tmp_path / "run")
    tables.write_parquet(offers.select(*S.TRAINING_INPUT, "offer_status"), source)
    params = learn.Params(iterations=3, depth=3)
    run = train_model.run(spark, source, out, params, demo.TEST_FROM)
    listed = runs.committed(spark, out)
    assert train_model.run(spark, source, out, params, demo.TEST_FROM) == run
    assert runs.committed(spark, out).collect() == listed.collect()
    read = lambda name: spark.read.parquet(f"{runs.run_path(out, run)}/{name}")
    about, metrics = listed.first(), read("metrics").first()
    assert about["run_id"] == run and about["seconds"] > 0 and about["precision"] == metrics["precision"]
    test_rows = about["test_rows"]
    assert sum(metrics[c] for c in ("tp", "fp", "fn", "tn")) == test_rows
    assert read("confusion").count() == 4
    assert read("importances").count() == read("change_importances").count() == len(S.MODEL_FEATURES)
    assert read("score_histogram").agg(F.sum("n_rows")).first()[0] == test_rows
    losses = read("loss_curve").filter("split = 'train'").orderBy("iteration").collect()
    assert losses[-1]["loss"] < losses[0]["loss"]
    # The kept model is the best prefix of the fit.
    curve = read("auc_curve").orderBy("iteration").collect()
    best = max(curve, key=lambda row: (row["roc_auc"], -row["iteration"]))
    assert [row["iteration"] for row in curve] == [1, 2, 3]
    assert about["best_iteration"] == best["iteration"]
    assert best["roc_auc"] == pytest.approx(read("roc_auc").first()[0])
    assert len(learn.trees_of(train_model.load_model(out, run)).trees) == best["iteration"]
    # A fresh session scores plain offers with what was saved.
    plain, scores = str(tmp_path / "plain.csv"), str(tmp_path / "scores")
    tables.write_csv(offers.select(*S.TRAINING_INPUT), plain)
    subprocess.run(
        [sys.executable, "-m", "cabinlift.plans.score_offers", "--model", f"{runs.run_path(out, run)}/model",
         "--input", plain, "--output", scores], check=True, cwd=Path(__file__).parent.parent, timeout=300,
        env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"})
    got = spark.read.parquet(scores)
    fitted = learn.score_offers(train_model.load_model(out, run), offers.select(*S.TRAINING_INPUT))
    key = lambda df: sorted((r["flight_number"], r["usd_base_amount"], r["offer_time"], round(r["score"], 9)) for r in df.collect())
    assert key(got) == key(fitted) and got.count() == offers.count()


def test_wide_categories_are_target_encoded(spark, offers):
    table = shared.written(learn.training_table(offers, demo.TEST_FROM))
    wide = "flight_number,carrier_code"
    fitted = learn.fit(table, learn.Params(iterations=2, depth=2, max_bins=64, target_encoded=wide))
    scored = learn.score(fitted.model, table.filter("split = 'test'"))
    assert scored.filter("score between 0 and 1").count() == table.filter("split = 'test'").count()


def test_reader_strictness(spark, tmp_path):
    path = tmp_path / "offers.csv"
    names = S.OFFERS.fieldNames()
    row = lambda **given: ",".join(given.get(name, "") for name in names) + "\n"
    path.write_text(
        ",".join(names) + "\n"
        + row(id="1", item_count="2.0", created="2025-01-01 10:00:00", base_amount="nan")
        + row(id="x", item_count="3", created="never", base_amount="1.5"))
    with pytest.raises(PySparkException):
        tables.read_offers(spark, str(path)).collect()
    rows = tables.read_offers(spark, str(path), strict=False).collect()
    assert [r["id"] for r in rows] == [1, None]
    assert [r["item_count"] for r in rows] == [2, 3]
    assert [r["created"] for r in rows] == [datetime(2025, 1, 1, 10), None]
    assert [r["base_amount"] for r in rows] == [None, 1.5]
    assert rows[0]["conf_num"] is None


FLIGHT = {
    "carrier_code": "K", "flight_number": "1", "departure_local_date_time": "2025-01-01 10:00:00",
    "cabin_type": "BUSINESS", "origination": "A", "destination": "B", "booking_fare_class": "J", "partner_id": "{}",
}


def flight_lines(*more):
    names = [*S.FLIGHTS.fieldNames(), *more]
    return ",".join(names) + "\n", ",".join(FLIGHT.get(name, "{}" if name in more else "") for name in names) + "\n"


def test_a_given_place_is_a_number(spark, tmp_path):
    path = tmp_path / "flights.csv"
    head, row = flight_lines("ingest_seq")
    path.write_text(head + row.format(5, 10) + row.format(6, 2) + row.format(7, ""))
    from cabinlift.operators import enrich

    kept = enrich.dedup_flights(enrich.typed_flights(tables.read_flights(spark, str(path))))
    assert [r["partner_id"] for r in kept.collect()] == [6]


def test_csv_keeps_quotes_and_raises_on_what_it_would_lose(spark, tmp_path):
    path = str(tmp_path / "quoted.csv")
    schema = "name string, item_count int"
    from pyspark.sql.types import StructType

    rows = [('a "b, c"', 7), ("line\nbreak", 8)]
    tables.write_csv(spark.createDataFrame(rows, schema), path)
    declared = StructType.fromDDL(schema)
    assert sorted(map(tuple, tables.read_table(spark, path, declared).collect())) == sorted(rows)
    part = tmp_path / "part.csv"
    part.write_text('name,item_count\n"a ""b, c""",7.9\n')
    with pytest.raises(PySparkException):
        tables.read_table(spark, str(part), declared).collect()
    assert [tuple(r) for r in tables.read_table(spark, str(part), declared, strict=False).collect()] == [('a "b, c"', None)]
    with pytest.raises(ValueError, match="lacks"):
        tables.read_table(spark, str(part), StructType.fromDDL(schema + ", created timestamp"))


def test_auctions_with_several_schedules_are_listed(spark, tmp_path):
    rows = offer_rows(spark, [
        {"id": 1}, {"id": 2, "flight_number": "2"},
        {"id": 3, "flight_number": "2", "event_local_date_48h": datetime(2025, 1, 3, 5)}])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(source)
    assert build_snapshots.run(spark, source, out, "2025-01-01") == build_snapshots.Report(1, {})
    made = {r[0] for r in spark.read.parquet(out).select("flight_number").distinct().collect()}
    left = {r[0] for r in spark.read.parquet(f"{out}_rejects").select("flight_number").collect()}
    assert (made, left) == ({"1"}, {"2"})


def test_values_that_do_not_parse_are_counted_and_listed(spark, tmp_path):
    rows = offer_rows(spark, [{"id": i, "flight_number": str(i)} for i in range(1, 6)])
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns]).withColumns({
        "created": F.when(F.col("id") == 2, "soon").otherwise(F.col("created")),
        "item_count": F.when(F.col("id").isin(2, 3), "1.5").otherwise(F.col("item_count")),
        "offer_time": F.when(F.col("id") == 4, "NaN").otherwise(F.col("offer_time"))})
    source, out = str(tmp_path / "in.csv"), str(tmp_path / "out")
    tables.write_csv(text, source)
    for apart in (True, False):
        report = build_snapshots.run(spark, source, out, "2025-01-01", collapse_exact_duplicates=apart)
        assert report == build_snapshots.Report(0, {"created": 1, "item_count": 2})
        listed = {r["id"]: (r["item_count"], set(r["made_null"])) for r in spark.read.parquet(f"{out}_coerced").collect()}
        assert listed == {"2": ("1.5", {"created", "item_count"}), "3": ("1.5", {"item_count"})}
    with pytest.raises(PySparkException):
        build_snapshots.run(spark, source, out, "2025-01-01", strict=True)
    typed, counts = tables.conform_and_count(rows, S.ENRICHED_SNAPSHOT)
    assert counts is None and bag(typed) == bag(rows)


def parts(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_update_equals_a_rebuild_and_leaves_other_months(spark, tmp_path):
    before = demo.enriched(spark, SMALL).select(*S.SNAPSHOT_INPUT)
    inside = F.trunc(F.col("travel_date").cast("date"), "month") == F.lit("1999-01-01").cast("date")
    ids = [r[0] for r in before.filter(inside).select("id").distinct().orderBy("id").limit(4).collect()]
    away = before.filter(~inside & (F.col("travel_date") >= "1996-01-01")).orderBy("id").first()
    moved = before.filter(F.col("id") == ids[0]).withColumn("id", F.lit(away["id"]))  # an id of another month comes back
    without_id = before.filter(F.col("id") == ids[1]).withColumn("id", F.lit(None).cast("bigint"))
    after = before.filter(~F.col("id").isin(ids[2:])).unionByName(moved).unionByName(without_id)
    paths = {name: str(tmp_path / name) for name in ("before", "after", "made", "anew")}
    for name, df in (("before", before), ("after", after)):
        tables.write_by_month(df, paths[name])
    build_snapshots.run(spark, paths["before"], paths["made"], demo.SNAPSHOT_FROM)
    old = parts(paths["made"])
    months = update_snapshots.run(spark, paths["before"], paths["after"], paths["made"], demo.SNAPSHOT_FROM)
    assert "1999-01-01" in months and 2 <= len(months) < 20
    build_snapshots.run(spark, paths["after"], paths["anew"], demo.SNAPSHOT_FROM)
    made, anew = (spark.read.parquet(paths[name]).select(*S.SNAPSHOT_OUTPUT) for name in ("made", "anew"))
    assert bag(made) == bag(anew)
    new = parts(paths["made"])
    untouched = lambda files: {k: v for k, v in files.items() if k.split("=")[1][:10] not in months}
    assert untouched(old) == untouched(new) != {}
    assert update_snapshots.run(spark, paths["after"], paths["after"], paths["made"], demo.SNAPSHOT_FROM) == []
    assert parts(paths["made"]) == new


def test_update_empties_a_month(spark, tmp_path):
    rows = [{"id": 1}, {"id": 2, "travel_date": datetime(2025, 3, 1)}]
    before, after, out = offer_rows(spark, rows), offer_rows(spark, rows[:1]), str(tmp_path / "out")
    tables.write_by_month(snapshots.auction_snapshots(before), out)
    assert update_snapshots.update(spark, before, after, out, None) == ["2025-03-01"]
    assert {r["id"] for r in spark.read.parquet(out).collect()} == {1}


@pytest.mark.parametrize("quoted", [False, True])
def test_rows_are_numbered_as_they_lie(spark, tmp_path, quoted):
    folder = tmp_path / "rows.csv"
    folder.mkdir()
    texts = [f"row {i}" + ("\nmore" if quoted and i % 50 == 7 else "") + 'x, "y"' * (i % 3) for i in range(900)]
    line = lambda t: '"' + t.replace('"', '""') + '"\n'
    for name, some in (("a.csv", texts[:600]), ("b.csv", texts[600:600]), ("c.csv", texts[600:])):
        (folder / name).write_text("text,row_no\n" + "".join(line(t).replace("\n", ",9\n") if "more" not in t else line(t)[:-1] + ",9\n" for t in some))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert tables.breaks_in_quotes(spark, str(folder)) == quoted
        got = tables.read_numbered(spark, str(folder))
        assert got.columns == ["text", "row_no"]
        assert [r["text"] for r in got.orderBy("row_no").collect()] == texts
        assert sorted(r["row_no"] for r in got.collect()) == list(range(900))
        tasks = tables._raw(spark, str(folder)).rdd.getNumPartitions()
        assert tasks > 5 if not quoted else tasks >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_input_order_decides_the_kept_flight(spark, tmp_path):
    folder = tmp_path / "flights.csv"
    folder.mkdir()
    head, row = flight_lines()
    (folder / "a.csv").write_text(head + row.format(5) + row.format(6))
    (folder / "b.csv").write_text(head + row.format(7) * 3)
    from cabinlift.operators import enrich

    kept = enrich.dedup_flights(enrich.typed_flights(tables.read_flights(spark, str(folder))))
    assert [r["partner_id"] for r in kept.collect()] == [5]


def test_cast_present_and_dotted(spark):
    df = spark.createDataFrame([("1", 2)], ["id", "a.b"])
    got = tables.cast_present(tables.drop_dotted(df), {"id": "bigint", "absent": "int"})
    assert got.dtypes == [("id", "bigint")]


def test_shared_folder_is_read_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    shared.written(spark.range(3), "probe")
    assert any(p.name.startswith("probe-") for p in Path(folder).iterdir())
