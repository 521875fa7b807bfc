"""ROC AUC of many scorings of the same rows at once, by histograms that add up.

Rows carry an array with one score per scoring, such as the margins after each
iteration of a fit. Tasks count rows by scoring, bin and label; the counts of
all tasks are added. Only bins with both labels hide an order, and only their
scores are counted one by one. Rows are read, never copied per scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cabinlift.sources.shared import written

#: Bins between the lowest and highest score of a scoring.
BINS = 4096
#: Distinct (scoring, score) counts a task holds before it hands them on.
HELD = 500_000


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Labels and scores, one row per row."""
    scores = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    return batch.column(0).to_numpy(zero_copy_only=False), scores.reshape(batch.num_rows, -1)


def _bin(scores: np.ndarray, low: np.ndarray, high: np.ndarray, bins: int) -> np.ndarray:
    """Never falls as the score rises, which is all that the count needs."""
    wide = np.where(high > low, high - low, 1.0)
    return np.minimum(((scores - low) / wide * bins).astype(np.int64), bins - 1)


def _spans(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of each scoring; one row per scoring reaches the driver."""

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                scores = _rows(batch)[1]
                low = scores.min(axis=0) if low is None else np.minimum(low, scores.min(axis=0))
                high = scores.max(axis=0) if high is None else np.maximum(high, scores.max(axis=0))
        if low is not None:
            yield pa.record_batch([pa.array(np.arange(len(low)), pa.int32()), pa.array(low), pa.array(high)], ["i", "low", "high"])

    found = rows.mapInArrow(span, "i int, low double, high double").groupBy("i").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").toPandas()
    return found["low"].to_numpy(), found["high"].to_numpy()


def _counts(rows: DataFrame, low: np.ndarray, high: np.ndarray, bins: int) -> DataFrame:
    """i, bin, hits, misses: as many rows as there are bins in use, whatever the data."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(low) * bins
        cells = np.zeros((2, n), np.int64)
        for batch in batches:
            if batch.num_rows:
                label, scores = _rows(batch)
                at = _bin(scores, low, high, bins) + np.arange(len(low)) * bins
                cells += [np.bincount(at[label == side].ravel(), minlength=n) for side in (1, 0)]
        used = np.flatnonzero(cells.any(axis=0))
        yield pa.record_batch([pa.array(used // bins, pa.int32()), pa.array(used % bins, pa.int32()),
                               pa.array(cells[0][used]), pa.array(cells[1][used])], ["i", "bin", "hits", "misses"])

    return rows.mapInArrow(count, "i int, bin int, hits long, misses long").groupBy("i", "bin").agg(
        F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))


def _inside(rows: DataFrame, low: np.ndarray, high: np.ndarray, bins: int, mixed: np.ndarray) -> DataFrame:
    """i, bin, score, hits, misses of the distinct scores in the bins that ``mixed`` marks."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def handed_on() -> pa.RecordBatch:
            which, score, hit = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((score, which))
            which, score, hit = which[order], score[order], hit[order]
            first = np.flatnonzero(np.append(True, (np.diff(which) != 0) | (np.diff(score) != 0)))
            hits, n = np.add.reduceat(hit, first), np.diff(np.append(first, len(which)))
            held.clear()
            return pa.record_batch([
                pa.array(which[first] // bins, pa.int32()), pa.array(which[first] % bins, pa.int32()),
                pa.array(score[first]), pa.array(hits), pa.array(n - hits)], ["i", "bin", "score", "hits", "misses"])

        for batch in batches:
            if batch.num_rows:
                label, scores = _rows(batch)
                at = _bin(scores, low, high, bins) + np.arange(len(low)) * bins
                inside = mixed[at]
                if inside.any():
                    hit = np.broadcast_to((label == 1).astype(np.int64)[:, None], at.shape)
                    held.append((at[inside], scores[inside], hit[inside]))
                if sum(len(x[0]) for x in held) > HELD:
                    yield handed_on()
        if held:
            yield handed_on()

    counted = rows.mapInArrow(exact, "i int, bin int, score double, hits long, misses long")
    return counted.groupBy("i", "bin", "score").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))


def auc_per_score(df: DataFrame, scores: str = "scores", label: str = "label", bins: int = BINS) -> DataFrame:
    """iteration, roc_auc: the exact area under the ROC curve of each place of ``scores``, counted from 1.

    ``label`` is 0 or 1; every row has as many finite scores as the others. Equal
    to ``evaluate.roc_auc`` of each scoring, to the last bit. Null where a label
    is missing; an empty table gives no row. ``df`` is read three times, so write
    it first if it is dear. What is sent is counts per bin, and distinct scores of
    bins with both labels, combined in each task.
    """
    rows = df.select(F.col(label).cast("int"), F.col(scores).cast("array<double>"))
    low, high = _spans(rows)
    spark = df.sparkSession
    if not len(low):
        return spark.createDataFrame([], "iteration int, roc_auc double")
    cells = written(_counts(rows, low, high, bins), "bins")
    # At most scorings x bins pairs of small numbers.
    both = cells.filter("hits > 0 and misses > 0").select("i", "bin").toPandas()
    mixed = np.zeros(len(low) * bins, bool)
    mixed[both["i"].to_numpy() * bins + both["bin"].to_numpy()] = True

    whole = lambda x: x.cast("decimal(18,0)")
    # Twice the area: every miss counts the hits above it twice and its equals once.
    above = Window.partitionBy("i").orderBy(F.desc("bin"))
    ranked = cells.select("i", "bin", "hits", "misses", (F.sum("hits").over(above) - F.col("hits")).alias("above"))
    between = ranked.groupBy("i").agg(
        F.sum(whole(F.col("misses")) * whole(2 * F.col("above"))).alias("area"),
        F.sum("hits").alias("positives"), F.sum("misses").alias("negatives"))
    within = Window.partitionBy("i", "bin").orderBy(F.desc("score"))
    strip: Column = whole(F.col("misses")) * whole(2 * F.sum("hits").over(within) - F.col("hits"))
    inner = _inside(rows, low, high, bins, mixed).select("i", strip.alias("strip")).groupBy("i").agg(F.sum("strip").alias("inner"))
    area = (F.col("area") + F.coalesce("inner", F.lit(0))).cast("double")
    return between.join(inner, "i", "left").select(
        (F.col("i") + 1).alias("iteration"),
        F.try_divide(area, F.lit(2.0) * F.col("positives") * F.col("negatives")).alias("roc_auc"))
