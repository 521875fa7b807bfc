"""Column expressions over whole texts that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches per inner fold; a running sum over n matches copies n * RUN entries at most.
RUN = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _ends(run: Column, base: Column) -> Column:
    start = F.struct(base.cast("int").alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + x["len"]
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"))

    return F.aggregate(run, start, step, lambda acc: acc["out"])


def _running(lens: Column) -> Column:
    """Gaps and lengths to starts and ends, in runs so that long lists stay linear."""

    def whole(all_lens: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_lens) - 1) / RUN).cast("int")),
            lambda k: F.slice(all_lens, k * RUN + 1, F.lit(RUN)),
        )
        total = lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + x["gap"] + x["len"])

        def with_bases(rs: Column) -> Column:
            bases = F.aggregate(
                F.transform(rs, total), F.array(F.lit(0)),
                lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t)),
            )
            return let(bases, lambda bs: F.flatten(F.transform(rs, lambda r, i: _ends(r, bs[i]))))

        return let(runs, with_bases)

    return let(lens, lambda x: F.when(F.size(x) <= RUN, _ends(x, F.lit(0))).otherwise(whole(x)))


def places(text: Column, pattern: Column, measure: Callable[[Column], Column] = F.length) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<s, e>>``, counted by ``measure``.

    ``measure`` must add up over neighbouring pieces; by default it counts code
    points. No match gives an empty array. The pattern must not match nothing.
    """
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    lens = F.filter(
        F.zip_with(pieces, found, lambda gap, hit: F.struct(measure(gap).alias("gap"), measure(hit).alias("len"))),
        lambda x: x["len"].isNotNull(),
    )
    return _running(lens)


def scanned(
    items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column]
) -> Column:
    """``emit(state, item)`` for every item, where the state has stepped over the items before it.

    Linear in the items: whole runs are stepped over first, and each run is then
    gone through from the state it begins with.
    """

    def one(run: Column, base: Column) -> Column:
        start = F.struct(base.alias("state"), F.slice(F.transform(run, lambda x: emit(base, x)), 1, 0).alias("out"))
        return F.aggregate(
            run, start,
            lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x))).alias("out")),
            lambda acc: acc["out"])

    def whole(xs: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda k: F.slice(xs, k * RUN + 1, F.lit(RUN)))
        bases = lambda rs: F.aggregate(
            rs, F.array(zero), lambda acc, r: F.concat(acc, F.array(F.aggregate(r, F.element_at(acc, -1), step))))
        return let(runs, lambda rs: let(bases(rs), lambda bs: F.flatten(F.transform(rs, lambda r, i: one(r, bs[i])))))

    return let(items, lambda xs: F.when(F.size(xs) <= RUN, one(xs, zero)).otherwise(whole(xs)))


def digest(items: Column) -> Column:
    """Lowercase hex SHA-256 of the comma-joined strings."""
    return F.sha2(F.array_join(items, ","), 256)
