"""Evaluation tables over (label, score) rows.

Every function takes optional ``by`` columns and evaluates each of those groups.
Curves need running totals in score order. Equal scores are counted first; the
distinct scores are then range-partitioned, scanned in blocks, and the blocks'
totals combined, so no task sees all scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cabinlift.operators import hot

THRESHOLD = 0.5
HISTOGRAM_BINS = 100


def with_prediction(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.withColumn("prediction", (F.col("score") >= threshold).cast("int"))


def _cell(label: int, prediction: int) -> Column:
    hit = (F.col("label") == label) & (F.col("prediction") == prediction)
    return F.count(F.when(hit, 1))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def threshold_metrics(
    scored: DataFrame, by: Sequence[str] = (), threshold: float = THRESHOLD
) -> DataFrame:
    """Precision, recall and accuracy; a zero denominator gives 0."""
    cells = with_prediction(scored, threshold).groupBy(*by).agg(
        _cell(1, 1).alias("tp"), _cell(0, 1).alias("fp"),
        _cell(1, 0).alias("fn"), _cell(0, 0).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))
    return cells.select(
        *by, tp, fp, fn, tn,
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def confusion(
    scored: DataFrame, by: Sequence[str] = (), threshold: float = THRESHOLD
) -> DataFrame:
    """All four cells, empty ones included, with their share of the true label."""
    cells = with_prediction(scored, threshold).groupBy(*by).agg(
        *[_cell(label, guess).alias(f"n{label}{guess}") for label in (0, 1) for guess in (0, 1)]
    )
    rows = F.array(*[
        F.struct(
            F.lit(label).alias("label"), F.lit(guess).alias("prediction"),
            F.col(f"n{label}{guess}").alias("n_rows"),
            _ratio(F.col(f"n{label}{guess}"), F.col(f"n{label}0") + F.col(f"n{label}1")).alias("share"),
        )
        for label in (0, 1) for guess in (0, 1)
    ])
    return cells.select(*by, F.explode(rows).alias("cell")).select(*by, "cell.*")


def running_counts(
    scored: DataFrame, by: Sequence[str] = (), blocks: int | None = None
) -> DataFrame:
    """One row per distinct score with counts at or above it.

    ``hits``/``misses`` count this score's labels, ``tp``/``fp`` those at or
    above it, ``positives``/``negatives`` all of the group. ``next_hits`` and
    ``next_misses`` belong to the next lower score and are null on the last row.
    To draw several curves, write this table once and use the ``_of`` functions.
    """
    by = list(by)
    counted = scored.groupBy(*by, "score").agg(
        F.sum(F.col("label").cast("bigint")).alias("hits"),
        F.sum(1 - F.col("label").cast("bigint")).alias("misses"),
    )
    cut = hot.range_blocks(counted, [*by, F.desc("score")], blocks)
    keys = [*by, hot.BLOCK]
    head = F.max(F.struct("score", "hits", "misses"))
    summary = cut.groupBy(*keys).agg(
        F.sum("hits").alias("tp_before"), F.sum("misses").alias("fp_before"),
        head["hits"].alias("first_hits"), head["misses"].alias("first_misses"),
    )
    group = Window.partitionBy(*(by or [F.lit(0)]))
    context = summary.select(
        *keys,
        F.sum("tp_before").over(group).alias("positives"),
        F.sum("fp_before").over(group).alias("negatives"),
        F.lead("first_hits").over(hot.neighbour(by)).alias("following_hits"),
        F.lead("first_misses").over(hot.neighbour(by)).alias("following_misses"),
        F.lag(hot.BLOCK).over(hot.neighbour(by)).isNull().alias("_first_block"),
    )
    edges = context.join(hot.blocks_before(summary, by, ["tp_before", "fp_before"]), keys)
    ordered = Window.partitionBy(*keys).orderBy(F.desc("score"))
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    # Without groups there is a row per block, and blocks are no more than partitions.
    return cut.join(hot.sized(edges) if by else F.broadcast(edges), keys).select(
        *by, "score", "hits", "misses", "positives", "negatives",
        (F.col("tp_before") + F.sum("hits").over(so_far)).alias("tp"),
        (F.col("fp_before") + F.sum("misses").over(so_far)).alias("fp"),
        F.coalesce(F.lead("hits").over(ordered), F.col("following_hits")).alias("next_hits"),
        F.coalesce(F.lead("misses").over(ordered), F.col("following_misses")).alias("next_misses"),
        (F.col("_first_block") & (F.row_number().over(ordered) == 1)).alias("is_first"),
    )


def roc_points(
    scored: DataFrame, by: Sequence[str] = (), blocks: int | None = None
) -> DataFrame:
    """ROC curve without the inner points that lie on a straight run.

    A point is dropped when the steps into and out of it are equal. The origin
    is added with an infinite threshold. A rate without any such label is null.
    """
    return roc_points_of(running_counts(scored, by, blocks), by)


def roc_points_of(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    bend = (F.col("next_hits") != F.col("hits")) | (F.col("next_misses") != F.col("misses"))
    corners = runs.filter(F.col("is_first") | F.col("next_hits").isNull() | bend)

    def point(fp: Column, tp: Column, threshold: Column) -> Column:
        return F.struct(
            F.try_divide(fp.cast("double"), F.col("negatives")).alias("fpr"),
            F.try_divide(tp.cast("double"), F.col("positives")).alias("tpr"),
            threshold.alias("threshold"),
        )

    own = point(F.col("fp"), F.col("tp"), F.col("score"))
    origin = point(F.lit(0), F.lit(0), F.lit(float("inf")))
    points = F.when(F.col("is_first"), F.array(origin, own)).otherwise(F.array(own))
    return corners.select(*by, F.inline(points))


def roc_auc(scored: DataFrame, by: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Area under the ROC curve by trapezoids, summed exactly in integers."""
    return roc_auc_of(running_counts(scored, by, blocks), by)


def roc_auc_of(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    whole = lambda x: x.cast("decimal(18,0)")
    strip = whole(F.col("misses")) * whole(2 * F.col("tp") - F.col("hits"))
    return (
        runs.groupBy(*by)
        .agg(
            F.sum(strip).cast("double").alias("area"),
            F.max("positives").alias("positives"), F.max("negatives").alias("negatives"),
        )
        .select(*by, F.try_divide(
            F.col("area"), F.lit(2.0) * F.col("positives") * F.col("negatives")
        ).alias("roc_auc"))
    )


def _recall() -> Column:
    return F.when(F.col("positives") == 0, F.lit(1.0)).otherwise(
        F.col("tp").cast("double") / F.col("positives")
    )


def pr_points(
    scored: DataFrame, by: Sequence[str] = (), blocks: int | None = None
) -> DataFrame:
    """Precision and recall at every distinct score, plus the end point (1, 0)."""
    return pr_points_of(running_counts(scored, by, blocks), by)


def pr_points_of(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    def point(precision: Column, recall: Column, threshold: Column) -> Column:
        return F.struct(
            precision.alias("precision"), recall.alias("recall"), threshold.alias("threshold")
        )

    precision = F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))
    own = point(precision, _recall(), F.col("score"))
    end = point(F.lit(1.0), F.lit(0.0), F.lit(None).cast("double"))
    points = F.when(F.col("is_first"), F.array(own, end)).otherwise(F.array(own))
    return runs.select(*by, F.inline(points))


def average_precision(
    scored: DataFrame, by: Sequence[str] = (), blocks: int | None = None
) -> DataFrame:
    """Precision averaged over the steps in recall."""
    return average_precision_of(running_counts(scored, by, blocks), by)


def average_precision_of(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    step = F.col("hits") * (F.col("tp").cast("double") / (F.col("tp") + F.col("fp")))
    return (
        runs.groupBy(*by)
        .agg(F.sum(step).alias("total"), F.max("positives").alias("positives"))
        .select(*by, F.when(F.col("positives") > 0, F.col("total") / F.col("positives"))
                .otherwise(F.when(F.col("positives") == 0, F.lit(0.0))).alias("average_precision"))
    )


def score_histogram(
    scored: DataFrame, by: Sequence[str] = (), bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Scores of each label in equal bins over that label's own range.

    The last bin includes its right edge; a single-valued label gets a range of
    one around its value. Empty bins are listed.
    """
    keys = [*by, "label"]
    spans = (
        scored.groupBy(*keys)
        .agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        .select(
            *keys,
            F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        )
    )
    lo, hi = F.col("lo"), F.col("hi")

    def edge(index: Column) -> Column:
        return F.when(index == bins, hi).otherwise(index * ((hi - lo) / bins) + lo)

    guess = F.least(F.floor((F.col("score") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    # The division may land a score next to an edge in the wrong bin.
    settled = (
        F.when(F.col("score") < edge(F.col("guess")), F.col("guess") - 1)
        .when((F.col("guess") < bins - 1) & (F.col("score") >= edge(F.col("guess") + 1)), F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    counts = (
        scored.join(hot.sized(spans) if by else F.broadcast(spans), keys)  # without groups, a row per label
        .withColumn("guess", guess)
        .groupBy(*keys, settled.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    frame = spans.select(*keys, lo, hi, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin",
        edge(F.col("bin")).alias("bin_from"), edge(F.col("bin") + 1).alias("bin_to"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )
