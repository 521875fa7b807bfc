"""Fitted boosted trees as data: shorter models, margins per iteration, importance.

Spark saves an ensemble as two small tables, the nodes and the weights of its
trees, next to its parameters. Everything here reads those, so one fit serves
every number of iterations.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from cabinlift.sources.shared import shared_path

_LEAVES = "_leaves"


def first_trees(spark: SparkSession, model: GBTClassificationModel, count: int) -> GBTClassificationModel:
    """The model that the same fit has after ``count`` iterations.

    The saved nodes and weights are filtered by the number of their tree; no
    tree is fitted again.
    """
    if not 1 <= count <= len(model.trees):
        raise ValueError(f"the model has {len(model.trees)} iterations, not {count}")
    whole, cut = shared_path(spark, "model"), shared_path(spark, "model")
    model.write().save(whole)
    spark.read.parquet(f"{whole}/data").filter(F.col("treeID") < count).write.parquet(f"{cut}/data")
    trees = spark.read.parquet(f"{whole}/treesMetadata")
    trees.filter(F.col(trees.columns[0]) < count).coalesce(1).write.parquet(f"{cut}/treesMetadata")
    about = json.loads(spark.read.text(f"{whole}/metadata").first()[0])
    about["numTrees"] = about["paramMap"]["maxIter"] = count
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{cut}/metadata")
    return GBTClassificationModel.load(cut)


@dataclass(frozen=True)
class Tree:
    """Nodes of a tree in the order of their numbers; -1 where a leaf has no children or feature."""

    weight: float
    prediction: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray

    @property
    def leaves(self) -> np.ndarray:
        """Nodes without children from left to right, which is how Spark numbers leaves."""
        return np.flatnonzero(self.left < 0)


def trees_of(spark: SparkSession, model: GBTClassificationModel) -> list[Tree]:
    """The trees of a model; as large as the model, whatever the data."""
    path = shared_path(spark, "model")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"), "nodeData.prediction", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex").toPandas().sort_values(["tree", "id"])
    return [
        Tree(float(model.treeWeights[number]), *(tree[c].to_numpy() for c in ("prediction", "leftChild", "rightChild", "featureIndex")))
        for number, tree in nodes.groupby("tree")
    ]


def with_leaves(model: GBTClassificationModel, assembled: DataFrame) -> DataFrame:
    """Add ``_leaves``: the number of the leaf that each tree routes the row to."""
    routed = model.copy({model.leafCol: _LEAVES}).transform(assembled)
    return routed.withColumn(_LEAVES, vector_to_array(_LEAVES).cast("array<int>"))


def with_margins(model: GBTClassificationModel, assembled: DataFrame, out: str = "margins") -> DataFrame:
    """Add the margin after 1, 2, ... iterations; the last one gives the model's score."""
    trees = trees_of(assembled.sparkSession, model)
    worth = [tree.weight * tree.prediction[tree.leaves] for tree in trees]

    @F.pandas_udf("array<double>")
    def margins(leaves: pd.Series) -> pd.Series:
        routed = np.stack(leaves.to_numpy()) if len(leaves) else np.zeros((0, len(worth)), np.int64)
        steps = np.stack([value[routed[:, i]] for i, value in enumerate(worth)], axis=1)
        return pd.Series(list(np.cumsum(steps, axis=1)))

    return with_leaves(model, assembled).withColumn(out, margins(_LEAVES))


def leaf_rows(model: GBTClassificationModel, assembled: DataFrame, weight: str | None = None) -> DataFrame:
    """tree, leaf, n_rows, total weight of the rows that each leaf receives; tasks count before they send."""
    routed = with_leaves(model, assembled).select(_LEAVES, (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            heavy = batch.column(1).to_numpy()
            for tree in range(leaves.shape[1]):
                found = np.stack([np.bincount(leaves[:, tree]), np.bincount(leaves[:, tree], weights=heavy)])
                if tree in rows:
                    wide = max(found.shape[1], rows[tree].shape[1])
                    found = sum(np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (found, rows[tree]))
                rows[tree] = found
        for tree, found in rows.items():
            leaf = np.flatnonzero(found[0])
            yield pa.record_batch([pa.array(np.full(len(leaf), tree), pa.int32()), pa.array(leaf, pa.int32()),
                                   pa.array(found[0][leaf], pa.int64()), pa.array(found[1][leaf], pa.float64())],
                                  ["tree", "leaf", "n_rows", "weight"])

    counted = routed.mapInArrow(count, "tree int, leaf int, n_rows long, weight double")
    return counted.groupBy("tree", "leaf").agg(F.sum("n_rows").alias("n_rows"), F.sum("weight").alias("weight"))


def prediction_change(trees: list[Tree], leaf_weights: dict[tuple[int, int], float], n_features: int) -> np.ndarray:
    """How much each feature moves the prediction, in per cent of all features.

    Each split stands between two subtrees. With their weights of rows and mean
    predictions it adds the weighted squared distances of the two means from
    their common mean to the feature it asks.
    """
    change = np.zeros(n_features)
    for number, tree in enumerate(trees):
        weight, total = np.zeros(len(tree.left)), np.zeros(len(tree.left))
        leaves = tree.leaves
        weight[leaves] = [leaf_weights.get((number, i), 0.0) for i in range(len(leaves))]
        total[leaves] = weight[leaves] * tree.prediction[leaves] * tree.weight
        # Children have larger numbers than their parent.
        for node in np.flatnonzero(tree.left >= 0)[::-1]:
            sides = [tree.left[node], tree.right[node]]
            weight[node], total[node] = weight[sides].sum(), total[sides].sum()
            if (weight[sides] > 0).all():
                means = total[sides] / weight[sides]
                change[tree.feature[node]] += float((weight[sides] * (means - total[node] / weight[node]) ** 2).sum())
    return 100.0 * change / change.sum() if change.sum() > 0 else change
