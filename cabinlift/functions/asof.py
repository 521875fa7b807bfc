"""As-of picks over a wide schedule of (reading time, value) column pairs.

A schedule is a list of ``(event column, value column)`` ordered from the
reading nearest the end to the earliest one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Schedule = Sequence[tuple[str, str]]


def value_before_decision(at: Column, schedule: Schedule) -> Column:
    """Value of the latest reading strictly before ``at``.

    ``at`` equal to a reading still counts as before it. At or before the
    earliest reading, that reading's value is used. After the nearest reading,
    or when either reading around ``at`` has no time, the result is null.
    """
    first_event, first_value = schedule[-1]
    result = None
    for (event, _), (earlier, value) in zip(schedule, schedule[1:]):
        inside = (at <= F.col(event)) & (at > F.col(earlier))
        result = F.when(inside, F.col(value)) if result is None else result.when(inside, F.col(value))
    at_start = at <= F.col(first_event)
    if result is None:
        return F.when(at_start, F.col(first_value))
    return result.when(at_start, F.col(first_value))


def reading_at(at: Column, schedule: Schedule, after_last: str = "earliest") -> Column:
    """Position in ``schedule`` of the reading shown at instant ``at``.

    Readings are tried from the earliest on; the first one still ahead of
    ``at`` selects the one listed before it (itself for the earliest).
    Readings without a time are passed over when looking ahead, but still count
    as "the one listed before". Once no reading is ahead, ``after_last``
    decides: ``"earliest"`` or ``"nearest"``.
    """
    last = len(schedule) - 1
    fallback = {"earliest": last, "nearest": 0}[after_last]
    result = F.when(at < F.col(schedule[last][0]), F.lit(last))
    for position in range(last - 1, -1, -1):
        result = result.when(at < F.col(schedule[position][0]), F.lit(position + 1))
    return result.otherwise(F.lit(fallback))


def reading_name(position: Column, schedule: Schedule) -> Column:
    return F.element_at(F.array(*[F.lit(value) for _, value in schedule]), position + 1)


def reading_value(position: Column, schedule: Schedule) -> Column:
    result = None
    for index, (_, value) in enumerate(schedule):
        hit = position == F.lit(index)
        result = F.when(hit, F.col(value)) if result is None else result.when(hit, F.col(value))
    return result
