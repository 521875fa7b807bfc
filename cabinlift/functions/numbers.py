"""Numeric expressions: rounding, caps and right-closed binning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_cents(x: Column) -> Column:
    """Scale, round half to even, unscale (differs from ``round``/``bround`` on 1.015)."""
    return F.rint(x * F.lit(100.0)) / F.lit(100.0)


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def right_closed_cut(x: Column, edges: Sequence[float], labels: Sequence) -> Column:
    """Bins ``(-inf, e0], (e0, e1], ..., (e_last, inf)``; null stays null.

    ``labels`` has one more entry than ``edges``.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("a cut needs one more label than edges")
    chain = F.when(x.isNull() | F.isnan(x.cast("double")), None)
    for edge, label in zip(edges, labels):
        chain = chain.when(x <= F.lit(edge), F.lit(label))
    return chain.otherwise(F.lit(labels[-1]))


def capped(x: Column, cap: int) -> Column:
    """``x`` up to ``cap``, else ``cap + 1``; null counts as above the cap."""
    return F.when(x <= F.lit(cap), x).otherwise(F.lit(cap + 1)).cast("int")


def clamped(x: Column, low: int, high: int, missing: int) -> Column:
    """Clamp to ``[low, high]``, ``missing`` for null, truncated toward zero."""
    return (
        F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(missing))
        .when(x <= F.lit(low), F.lit(low))
        .when(x >= F.lit(high), F.lit(high))
        .otherwise(x)
        .cast("int")
    )
