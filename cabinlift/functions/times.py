"""Expressions on zone-less timestamps.

Only operations that stay zone-less are used: ``timestamp_diff`` and
``date_trunc`` would pass through the session time zone and its clock changes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"
SECONDS_PER_DAY = 86_400.0


def to_ntz(text: Column, strict: bool = True) -> Column:
    """Parse text; a bad value raises when ``strict``, else becomes null."""
    return text.cast(NTZ) if strict else text.try_cast(NTZ)


def day(ts: Column) -> Column:
    return ts.cast("date").cast(NTZ)


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month").cast(NTZ)


def days_between(earlier: Column, later: Column) -> Column:
    """Seconds first, then days, as two divisions."""
    seconds = (later - earlier).cast("interval second").cast("decimal(18,6)").cast("double")
    return seconds / F.lit(SECONDS_PER_DAY)


def midpoint(earlier: Column, later: Column) -> Column:
    """Halfway instant in whole microseconds, rounded toward ``earlier``.

    Halving an interval rounds half up, so the half is taken off ``later``:
    added to ``earlier``, a gap of one microsecond would give its right end.
    """
    return later - (later - earlier) / F.lit(2)


def minus_minutes(ts: Column, minutes: Column) -> Column:
    """Subtract a possibly fractional or negative number of minutes."""
    seconds = (minutes * F.lit(60)).cast("decimal(18,6)")
    return ts - F.make_dt_interval(secs=seconds)


def shifted(ts: Column, from_clock: Column, to_clock: Column) -> Column:
    """Move ``ts`` by the distance between two clocks."""
    return ts + (to_clock - from_clock)
