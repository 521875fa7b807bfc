"""Encoding, cut models, importance, curves and runs against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from cabinlift.operators import encode, evaluate, forest, learn, ranks
from cabinlift.sources import demo, runs, shared, tables
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def table(spark, offers):
    return shared.written(learn.training_table(offers, demo.TEST_FROM))


@pytest.fixture(scope="module")
def fitted(table):
    return learn.fit(table, learn.Params(iterations=4, depth=3))


# Target rates

@pytest.mark.parametrize("blocks", [1, 7])
def test_ordered_rates_equal_a_loop(spark, blocks):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 30 + ["a", "b", None, ""]), rng.randint(0, 1), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, kind string, label int, at double").repartition(5)
    got = encode.ordered_target_rates(df, "kind", order=["at", "id"], smoothing=2.0, prior=0.25, blocks=blocks).collect()
    seen, want = defaultdict(lambda: [0, 0]), {}
    for i, kind, label, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        n, hits = seen[kind]
        want[i] = (hits + 0.5) / (n + 2.0)
        seen[kind] = [n + 1, hits + label]
    assert {r["id"]: r["kind_rate"] for r in got} == want
    table = {r["category"]: (r["n_rows"], r["n_hits"]) for r in encode.target_rates(df, "kind").collect()}
    assert table == {k: tuple(v) for k, v in seen.items()}


def test_a_row_never_sees_its_own_label(spark):
    """Changing one label changes no rate of that row, nor of those before it."""
    rows = [(i, "x", i % 2) for i in range(50)]
    rates = lambda rows: {r["id"]: r["kind_rate"] for r in encode.ordered_target_rates(
        spark.createDataFrame(rows, "id int, kind string, label int"), "kind", order=["id"]).collect()}
    before = rates(rows)
    after = rates([(i, k, 1 - y if i == 20 else y) for i, k, y in rows])
    assert all(before[i] == after[i] for i in range(21)) and all(before[i] != after[i] for i in range(21, 50))


def test_rates_without_rows_and_without_an_order(spark):
    df = spark.createDataFrame([], "id int, kind string, label int")
    assert encode.ordered_target_rates(df, "kind").collect() == []
    same = spark.createDataFrame([(1, "x", y) for y in (1, 0, 1)], df.schema)
    got = encode.ordered_target_rates(same, "kind").orderBy("kind_rate").collect()
    assert sorted(r["kind_rate"] for r in got) == [0.25, 0.5, 0.5]  # 0, 1, 1 by label within the one place


def test_unknown_categories_get_the_prior(spark):
    rates = spark.createDataFrame([("a", 0.9), (None, 0.2)], "category string, rate double")
    df = spark.createDataFrame([("a",), ("b",), (None,)], "kind string")
    got = {r["kind"]: r["kind_rate"] for r in encode.with_target_rates(df, rates, "kind").collect()}
    assert got == {"a": 0.9, "b": 0.5, None: 0.2}


# One fit

def test_one_fit(spark, table, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    calls = []
    real = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, *a, **k: calls.append(1) or real(self, *a, **k))
    result = learn.fit(table, learn.Params(iterations=3, depth=2))
    assert len(calls) == 1
    assert len(learn.trees_of(result.model).trees) == result.best_iteration
    assert len(learn.trees_of(result.full).trees) == 3


@pytest.mark.parametrize("count", [1, 3])
def test_cut_models_score_as_the_prefix(spark, table, fitted, count):
    trees = learn.trees_of(fitted.full)
    cut = forest.first_trees(spark, trees, count)
    assert [t.toDebugString.split("\n")[1:] for t in cut.trees] == [t.toDebugString.split("\n")[1:] for t in trees.trees[:count]]
    model = PipelineModel([*fitted.full.stages[:-1], cut])
    scores = {r["id"]: r["score"] for r in learn.score(model, table.filter("split = 'test'")).collect()}
    margins = learn.validation_margins(fitted.full, table).collect()
    assert len(margins) == len(scores) > 0
    for row in margins:
        assert scores[row["id"]] == pytest.approx(1 / (1 + np.exp(-2 * row["margins"][count - 1])))


@pytest.mark.parametrize("count", [0, 5])
def test_a_cut_stays_within_the_fit(spark, fitted, count):
    with pytest.raises(ValueError):
        forest.first_trees(spark, learn.trees_of(fitted.full), count)


def test_curve_equals_the_auc_of_each_prefix(table, fitted):
    margins = learn.validation_margins(fitted.full, table)
    for row in fitted.curve.collect():
        one = margins.select("label", F.col("margins")[row["iteration"] - 1].alias("score"))
        assert row["roc_auc"] == evaluate.roc_auc(one).first()[0]


def test_saved_model_takes_plain_offers(spark, offers, table, fitted, tmp_path):
    fitted.model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    plain = offers.drop("offer_status", "decision_timestamp").withColumn("features_of_mine", F.lit(1))
    got = learn.score_offers(loaded, plain)
    assert got.columns == [*plain.columns, "score", "prediction"]
    want = {r["id"]: r["score"] for r in learn.score(fitted.model, table).collect()}
    assert {r["id"]: r["score"] for r in got.collect()} == want


# Curves of many scorings

@pytest.mark.parametrize("bins", [1, 3, 4096])
@pytest.mark.parametrize("held", [10, 10**6])
def test_auc_per_score_equals_auc(spark, bins, held, monkeypatch):
    monkeypatch.setattr(ranks, "HELD", held)
    rng = np.random.default_rng(6)
    rows = [(int(y), [float(y), 0.5, -float(y), *np.round(rng.normal(size=3) + y, 1).tolist(), float(rng.normal())])
            for y in rng.integers(0, 2, 500)]
    df = spark.createDataFrame(rows, "label int, scores array<double>").repartition(4)
    got = {r["iteration"]: r["roc_auc"] for r in ranks.auc_per_score(df, bins=bins).collect()}
    assert sorted(got) == list(range(1, 8))
    for k in range(7):
        one = df.select("label", F.col("scores")[k].alias("score"))
        assert got[k + 1] == evaluate.roc_auc(one).first()[0]


def test_auc_per_score_without_rows_or_labels(spark):
    empty = spark.createDataFrame([], "label int, scores array<double>")
    assert ranks.auc_per_score(empty).collect() == []
    one = spark.createDataFrame([(1, [0.1, 0.2])] * 3, empty.schema)
    assert [r["roc_auc"] for r in ranks.auc_per_score(one).collect()] == [None, None]


# Importance

def plain_change(trees, leaves, n):
    """Every node's rows, one by one."""
    out = np.zeros(n)
    for t, tree in enumerate(trees):
        order = {node: i for i, node in enumerate(tree.leaves)}

        def below(node):
            return [node] if tree.left[node] < 0 else below(tree.left[node]) + below(tree.right[node])

        for node in range(len(tree.left)):
            if tree.left[node] >= 0:
                values = [[tree.prediction[x] * tree.weight for x in below(side) for row in leaves if row[t] == order[x]]
                          for side in (tree.left[node], tree.right[node])]
                if all(values):
                    mean = np.mean(values[0] + values[1])
                    out[tree.feature[node]] += sum(len(v) * (np.mean(v) - mean) ** 2 for v in values)
    return 100 * out / out.sum()


def test_change_importance_equals_plain(spark, table, fitted):
    train = table.filter("split = 'train'")
    trees = learn.trees_of(fitted.full)
    routed = forest.with_leaves(trees, learn._assembled(fitted.full, train)).select("_leaves").collect()
    want = plain_change(forest.trees_of(spark, trees), [r[0] for r in routed], 17)
    got = learn.change_importances(fitted.full, train)
    assert [v for _, v in got] == sorted(v for _, v in got)
    from cabinlift import schema as S
    assert dict(got) == pytest.approx(dict(zip(S.MODEL_FEATURES, want)))
    assert sum(v for _, v in got) == pytest.approx(100)
    assert forest.prediction_change([], {}, 3).tolist() == [0, 0, 0]


# Runs

def test_run_ids_name_content(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    same = runs.run_id({"p": 1}, df)
    assert same == runs.run_id({"p": 1}, df.orderBy(F.desc("x")).select("y", "x").repartition(3))
    assert len({same, runs.run_id({"p": 2}, df), runs.run_id({"p": 1}, df.filter("x = 1")), runs.run_id({"p": 1}, df.distinct()),
                runs.run_id({"p": 1}, df.fillna(""))}) == 5


def test_only_whole_runs_are_listed(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert runs.committed(spark, folder) is None and not runs.is_committed(spark, folder, "r1")
    tables.write_parquet(spark.range(3), f"{runs.run_path(folder, 'r1')}/scores")  # breaks off here
    assert runs.committed(spark, folder) is None
    runs.commit(spark, folder, "r1", {"auc": 0.5, "rows": 3})
    runs.commit(spark, folder, "r1", {"auc": 0.5, "rows": 3})
    runs.commit(spark, folder, "r2", {"auc": 0.75, "rows": 4, "note": "more"})
    got = {r["run_id"]: r.asDict() for r in runs.committed(spark, folder).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"]["note"] is None and got["r2"]["auc"] == 0.75
    assert runs.is_committed(spark, folder, "r2")
