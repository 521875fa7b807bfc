"""Hand-computed cases."""

from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cabinlift.functions import numbers, times
from cabinlift.operators import enrich, evaluate, features, groups, hygiene, snapshots, timeline
from cabinlift.schema import AUCTION_KEY
from tests.support import offer_rows, t

A = {"id": 1, "created": t("1"), "decision_timestamp": t("5")}
B = {"id": 2, "created": t("3"), "decision_timestamp": t("5")}


def shown(df):
    rows = df.orderBy("snapshot_num", "id").select(
        "current_timestamp", "id", "current_seats_col", "current_available_seats", "snapshot_num"
    ).collect()
    return [(r[0], r[1], r[2][-3:], r[3], r[4]) for r in rows]


def test_snapshots(spark):
    assert shown(snapshots.auction_snapshots(offer_rows(spark, [A, B]))) == [
        (t("1"), 1, "72h", 10, 1),
        (t("3"), 1, "48h", 8, 2), (t("3"), 2, "48h", 8, 2),
        (t("4 6:00"), 1, "24h", 6, 3), (t("4 6:00"), 2, "24h", 6, 3),
        (t("4 17:30"), 1, "12h", 4, 4), (t("4 17:30"), 2, "12h", 4, 4),
        (t("4 23:30"), 1, "72h", 10, 5), (t("4 23:30"), 2, "72h", 10, 5),
    ]


def test_snapshots_nearest_after_last_reading(spark):
    rows = shown(snapshots.auction_snapshots(offer_rows(spark, [A, B]), "01h"))
    assert rows[-1] == (t("4 23:30"), 2, "01h", 2, 5)


def test_instants(spark):
    rows = timeline.snapshot_instants(offer_rows(spark, [A, B])).orderBy("instant_num").collect()
    assert [r["current_timestamp"] for r in rows] == [
        t("1"), t("2 12:00"), t("3"), t("3 12:00"), t("4 6:00"), t("4 17:30"), t("4 23:30"),
    ]


def test_missing_reading_still_counts_as_the_one_before(spark):
    gone = {"event_local_date_48h": None}
    rows = shown(snapshots.auction_snapshots(offer_rows(spark, [A | gone, B | gone])))
    # January 2nd 12:00 already shows it: the next reading with a time is 24h.
    assert [row[1:] for row in rows if row[4] in (2, 3)] == [
        (1, "48h", 8, 2), (1, "48h", 8, 3), (2, "48h", 8, 3)]


def test_no_decision_no_snapshots(spark):
    rows = [A | {"decision_timestamp": None}, B | {"decision_timestamp": None}]
    assert snapshots.auction_snapshots(offer_rows(spark, rows)).count() == 0


def test_offer_decided_before_it_was_made_never_shows(spark):
    late = {"id": 3, "created": t("4"), "decision_timestamp": t("3")}
    assert 3 not in {row[1] for row in shown(snapshots.auction_snapshots(offer_rows(spark, [A, late])))}


def test_offer_made_just_before_the_start_and_decided_at_it(spark):
    # Start is January 2nd, the first instant a day earlier; offer 3 lies between.
    brief = {"id": 3, "created": t("1 12:00"), "decision_timestamp": t("2")}
    rows = shown(snapshots.auction_snapshots(offer_rows(spark, [A, brief])))
    assert {row[1] for row in rows} == {1}
    assert [row[0] for row in rows][:2] == [t("1"), t("3 12:00")]


def test_two_schedules_are_rejected(spark):
    other = B | {"event_local_date_72h": t("2 1:00")}
    rows = offer_rows(spark, [A, other, A | {"id": 9, "flight_number": "2"}])
    assert {row[1] for row in shown(snapshots.auction_snapshots(rows))} == {9}
    conflict = hygiene.schedule_conflicts(rows).collect()
    assert [(r["flight_number"], r["n_schedules"]) for r in conflict] == [("1", 2)]
    with pytest.raises(PySparkException):
        snapshots.auction_snapshots(rows, strict_schedule=True).collect()


def test_rows_without_auction_key_yield_nothing(spark):
    assert snapshots.auction_snapshots(offer_rows(spark, [A | {"upgrade_type": None}])).count() == 0


def quantiles_of(spark, amounts):
    rows = [{"id": i, "usd_base_amount": x} for i, x in enumerate(amounts)]
    out = groups.loo_quantiles(offer_rows(spark, rows)).orderBy("id").collect()
    return [tuple(r[name] for name in groups.QUANTILES) for r in out]


def test_leave_one_out(spark):
    got = quantiles_of(spark, [100.0, 200.0, 300.0, 400.0])
    assert got[3] == (150.0, 200.0, 250.0) and got[0] == (250.0, 300.0, 350.0)
    assert quantiles_of(spark, [100.0, 200.0]) == [(200.0,) * 3, (100.0,) * 3]
    assert quantiles_of(spark, [100.0]) == [(None,) * 3]
    assert quantiles_of(spark, [100.0] * 3) == [(100.0,) * 3] * 3


def test_leave_one_out_with_missing_value(spark):
    # The missing amount sorts last; it spoils a quantile whose neighbour it is.
    got = quantiles_of(spark, [100.0, 200.0, None])
    assert got[2] == (125.0, 150.0, 175.0)
    assert got[0] == (None,) * 3


def test_leave_one_out_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    amounts = [float(x) for x in rng.integers(1, 40, 60)]
    got = quantiles_of(spark, amounts)
    for i, row in enumerate(got):
        assert row == pytest.approx(tuple(np.quantile(np.delete(amounts, i), [0.25, 0.5, 0.75])))


@pytest.mark.parametrize("column, build, cases", [
    ("usd_base_amount", features.amount_bins, [
        (-5.0, "<100"), (100.0, "<100"), (100.01, "100-200"), (200.0, "100-200"),
        (1700.0, "1600-1700"), (1700.01, ">1700"), (None, None)]),
    ("offer_time", features.offer_time_bins, [
        (-1.0, None), (0.0, None), (0.5, 1), (1.0, 1), (1.0001, 2), (30.0, 30), (30.5, 31), (None, None)]),
    ("seats_available", features.seats_bins, [
        (None, -2), (-7.0, -1), (-1.0, -1), (-0.5, 0), (29.0, 29), (30.0, 30), (55.0, 30)]),
])
def test_bins(spark, column, build, cases):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], f"i int, {column} double")
    got = build(rows).orderBy("i").collect()
    assert [row[f"{column}_grp"] for row in got] == [want for _, want in cases]


def test_capped_counts(spark):
    rows = spark.createDataFrame([(1, 4, 15), (2, 5, 16), (3, 9, 40), (4, None, 1)],
                                 "i int, item_count int, num_offers int")
    got = features.capped_counts(rows).orderBy("i").collect()
    assert [r["item_count_grp"] for r in got] == [4, 5, 5, 5]
    assert [r["num_offers_grp"] for r in got] == [15, 16, 16, 1]


@pytest.mark.parametrize("at, seats, gone", [
    ("1", 10, {}), ("2", 10, {}), ("2 12:00", 10, {}), ("3", 10, {}), ("4 6:00", 6, {}),
    ("4 23:00", 4, {}), ("4 23:30", None, {}), ("4 6:00", None, {"event_local_date_24h": None}),
])
def test_seats_at_decision(spark, at, seats, gone):
    row = offer_rows(spark, [{"decision_timestamp": t(at)} | gone])
    assert enrich.seats_at_decision(row).first()["seats_available"] == seats


SCORES = [(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.5), (0, 0.2)]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(SCORES, "label int, score double")


@pytest.mark.parametrize("blocks", [None, 3])
def test_curves(scored, blocks):
    assert evaluate.roc_auc(scored, blocks=blocks).first()[0] == pytest.approx(8 / 9)
    assert evaluate.average_precision(scored, blocks=blocks).first()[0] == pytest.approx(11 / 12)
    points = evaluate.roc_points(scored, blocks=blocks).orderBy(F.desc("threshold")).collect()
    third = pytest.approx(1 / 3), pytest.approx(2 / 3)
    assert [(p["fpr"], p["tpr"]) for p in points] == [
        (0, 0), (0, third[0]), (0, third[1]), (third[0], third[1]), (third[0], 1), (1, 1)]


def test_metrics(scored):
    row = evaluate.threshold_metrics(scored).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (3, 2, 0, 1)
    assert (row["precision"], row["recall"]) == (pytest.approx(0.6), 1.0)
    assert row["accuracy"] == pytest.approx(4 / 6)
    shares = {(r["label"], r["prediction"]): r["share"] for r in evaluate.confusion(scored).collect()}
    assert shares == {(0, 0): pytest.approx(1 / 3), (0, 1): pytest.approx(2 / 3), (1, 0): 0.0, (1, 1): 1.0}
    weights = features.class_weights(scored).collect()
    assert {r["label"]: r["class_weight"] for r in weights} == {0: 1.0, 1: 1.0}


def test_one_sided_labels(spark):
    only = spark.createDataFrame([(0, 0.2), (0, 0.4)], "label int, score double")
    row = evaluate.threshold_metrics(only).first()
    assert (row["precision"], row["recall"], row["accuracy"]) == (0.0, 0.0, 1.0)
    assert evaluate.roc_auc(only).first()[0] is None
    assert evaluate.average_precision(only).first()[0] == 0.0
    assert {p["recall"] for p in evaluate.pr_points(only).collect()} == {0.0, 1.0}


def test_histogram_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(int(label), float(np.round(x, 3))) for label, x in zip(rng.integers(0, 2, 900), rng.random(900))]
    rows += [(2, 0.25)] * 4
    table = evaluate.score_histogram(spark.createDataFrame(rows, "label int, score double")).collect()
    for label in (0, 1, 2):
        mine = sorted((r["bin"], r["n_rows"], r["bin_from"]) for r in table if r["label"] == label)
        counts, edges = np.histogram([x for k, x in rows if k == label], bins=100)
        assert [n for _, n, _ in mine] == list(counts)
        assert [low for _, _, low in mine] == list(edges[:-1])


def test_unique_ids(spark):
    rows = offer_rows(spark, [
        {"id": 1}, {"id": 1}, {"id": 2}, {"id": 2, "conf_num": "D"}, {"id": 3},
        {"id": None, "conf_num": "E"}, {"id": None, "conf_num": "F"},
    ])
    ids = lambda df: sorted((r["id"] for r in df.collect()), key=lambda x: (x is None, x))
    assert ids(hygiene.unique_by(rows, "id")) == [1, 3, None, None]
    assert ids(hygiene.unique_by(rows, "id", collapse_exact=False)) == [3, None, None]


def test_keep_first(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, seq int, v string")
    assert sorted(hygiene.keep_first(rows, ["k"], "seq").collect()) == [("a", 1, "y"), ("b", 1, None)]


def test_expressions(spark):
    one = spark.range(1)
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    micro = times.midpoint(at("2025-01-01 00:00:00"), at("2025-01-01 00:00:00.000001"))
    utc = times.minus_minutes(at("2025-01-01 00:00:00"), F.lit(-330))
    row = one.select(
        numbers.round_cents(F.lit(1.015)).alias("a"), numbers.round_cents(F.lit(0.125)).alias("b"),
        micro.alias("m"), utc.alias("u"), F.weekday(at("2025-01-06 00:00:00")).alias("dow"),
        times.to_ntz(F.lit("bad"), strict=False).alias("bad"),
        times.month_start(at("2025-02-17 10:00:00")).alias("month"),
    ).first()
    assert (row["a"], row["b"], row["m"]) == (1.01, 0.12, datetime(2025, 1, 1))
    assert (row["u"], row["dow"], row["bad"]) == (datetime(2025, 1, 1, 5, 30), 0, None)
    assert row["month"] == datetime(2025, 2, 1)
    with pytest.raises(PySparkException):
        spark.createDataFrame([("bad",)], "x string").select(times.to_ntz(F.col("x"))).collect()


def test_group_stats_can_be_repeated(spark):
    rows = offer_rows(spark, [{"id": 1, "usd_base_amount": 5.0}, {"id": 2, "usd_base_amount": None}])
    twice = groups.group_stats(groups.group_stats(rows)).collect()
    assert {(r["num_offers"], r["usd_base_amount_max"]) for r in twice} == {(2, 5.0)}
    assert [c for c in AUCTION_KEY if c not in twice[0].asDict()] == []
