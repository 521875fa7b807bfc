"""Quality scores: random Fourier features, ridge from summed normal equations, isotonic calibration.

A document becomes a short vector of statistics over its whole text. Cosines of
random projections of that vector approximate a Gaussian kernel, so a linear
fit on them is a kernel fit whose size does not depend on the data: every
partition sums its products of features, the sums are added up, and one system
of ``FEATURES + 1`` unknowns is solved. Labelled rows that the fit has not seen
turn raw scores into probabilities by a monotone curve over fixed bins.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cabinlift.sources.shared import written

# Folds and threshold of the data contract.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

#: The fold that calibrates; the others fit.
CALIBRATES = 4
FEATURES, WIDTH, RIDGE, SEED = 256, 4.0, 1.0, 20240
#: Bins of raw scores from -0.5 to 1.5 in which labels are counted for the curve.
BINS = 2048
#: Partial sums per fit; each is a matrix of ``FEATURES + 1`` squared.
SUMS = 64

_CLASS = np.full(256, 0)
_CLASS[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 1
_CLASS[np.frombuffer(b"0123456789", np.uint8)] = 2
_CLASS[np.frombuffer(b".,;:'\"?-()", np.uint8)] = 3
_CLASS[np.frombuffer(b"!", np.uint8)] = 4
_CLASS[np.frombuffer(b"#$%&*@^~=+<>\\/_{}[]`", np.uint8)] = 5
_CLASS[np.frombuffer(b"|", np.uint8)] = 6
_CLASS[np.frombuffer(b" \t\r\v\f", np.uint8)] = 7
_CLASS[10] = 8
_CLASS[128:] = 9
#: Nine byte classes, then the statistics of words and lines.
STATS = 9 + 9


def statistics(text: str | None) -> np.ndarray:
    """What the model sees of a text; nothing in it grows faster than its logarithm. Null counts as empty."""
    data = (text or "").encode("utf-8", "replace")
    words, lines = data.split(), data.split(b"\n")
    size, n = max(1, len(data)), max(1, len(words))
    shares = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=10)[1:] / size
    kinds = set(words)
    ends = sum(map(operator.methodcaller("endswith", b"."), words))
    return np.concatenate((np.minimum(shares * 10, 5), [
        np.log1p(len(data)), np.log1p(len(words)), min(30.0, len(data) / n) / 5,
        len(kinds) / n, np.log1p(len(words)) - np.log1p(len(kinds)),
        3 * sum(map(operator.eq, words, words[1:])) / n,
        min(1.0, 5 * ends / n), len(set(lines)) / len(lines), np.log1p(len(data) / len(lines)),
    ]))


def _table(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(-1, STATS)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _table(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(list(rows), pa.list_(pa.float64()))], names=["doc_id", "x"])


class Model:
    """Scale of the statistics, random projection, weights and calibration curve: a few hundred kilobytes."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray) -> None:
        random = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.turns = random.normal(size=(STATS, FEATURES)) / WIDTH
        self.phases = random.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.curve = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.spread, -8, 8)
        z = np.sqrt(2 / FEATURES) * np.cos(scaled @ self.turns + self.phases)
        return np.hstack((z, np.ones((len(x), 1))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.curve), 0.0, 1.0)


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _bins(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def _normal(model: Model):
    """Arrow function: the sums over one partition, a row of the matrix per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column("x").to_pylist()))
                y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
                total += np.hstack((z.T @ z, z.T @ y[:, None]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(FEATURES + 1, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    return run


def _add(group: pa.Table) -> pa.Table:
    return pa.table({"i": group.column("i")[:1], "sums": pa.array(
        [np.sum(np.array(group.column("sums").to_pylist()), axis=0)], pa.list_(pa.float64()))})


def _counted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = _bins(model.raw(np.array(batch.column("x").to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["at", "y"])

    return run


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares curve: pooled neighbours at their mean place."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled rows of all folds but the held-out one.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality; other columns
    are not read. Labels that are null or neither 0 nor 1 are left out, and so
    are documents whose labels contradict each other; a label that is repeated
    counts once. Without any label every score is 0.5. All labelled rows count; only sums of fixed
    size reach the driver.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").drop("other")
    known = known.withColumn("fold", _fold(F.col("doc_id"))).filter(F.col("fold") != HELD_OUT)
    stats = docs.select("doc_id", "text").filter(_fold(F.col("doc_id")) != HELD_OUT).mapInArrow(
        _described, "doc_id long, x array<double>")
    rows = written(stats.join(known, "doc_id").select("fold", "x", "y"), "labelled")
    xs = [F.col("x")[i] for i in range(STATS)]
    summary = rows.agg(F.count("*"), *[F.avg(c) for c in xs], *[F.stddev_pop(c) for c in xs]).first()
    if not summary[0]:
        return Model(np.zeros(STATS), np.ones(STATS))
    model = Model(np.array(summary[1:STATS + 1], float), np.array(summary[STATS + 1:], float))
    used = rows.filter(F.col("fold") != CALIBRATES)
    sums = (
        used.coalesce(SUMS).mapInArrow(_normal(model), "i int, sums array<double>")
        .groupBy("i").applyInArrow(_add, "i int, sums array<double>").collect()
    )
    total = np.array([r.sums for r in sorted(sums, key=lambda r: r.i)])
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])
    for chosen in (rows.filter(F.col("fold") == CALIBRATES), rows):
        bins = (
            chosen.select("x", "y").mapInArrow(_counted(model), "at long, y int")
            .groupBy("at").agg(F.count("*").alias("n"), F.sum("y").alias("good")).orderBy("at").collect()
        )
        if bins:
            at, n, good = (np.array(c, float) for c in zip(*bins))
            model.curve = isotonic((at + 0.5) / BINS * 2 - 0.5, good / n, n)
            break
    return model


def score_column(model: Model, text: Column) -> Column:
    """The probability that a text's label is 1; whole texts, null as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_table(texts)))

    return score(text)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document row. A null doc_id is not held out."""
    model = fit(docs, labels)
    return (
        docs.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
                    score_column(model, F.col("text")).alias("score"))
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns."""
    return docs.filter(score_column(fit(docs, labels), F.col("text")) >= THRESHOLD)
