"""Mix sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source is wanted ``target / source_size`` times. The whole
part is taken as it is; the fractions are rounded so that the source's words
stay at its target: two documents meet, word mass moves from one to the other
in a random direction until one fraction is 0 or 1, and the other goes on. Runs
of about ``BLOCK`` documents do this side by side; what each run leaves over
meets in the next level, a tree of fan-in ``BLOCK`` whose depth grows with the
logarithm of the largest source. Large documents meet first, so that small ones
are still open to even them out and what is left at the root is small. Only
that last document of a source is rounded alone, to the nearer side.

All choices are hashes of the document id, so reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cabinlift.llm.columns import let
from cabinlift.sources.shared import written

# The words, weights and limit of the data contract.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0

#: Documents per run, and so the fan-in of the tree.
BLOCK = 64
#: Sources up to which their table is broadcast; beyond it is joined by shuffle.
BROADCAST_SOURCES = 100_000
NEAR = 1e-9


def _sized(docs: DataFrame) -> DataFrame:
    """Equal rows once, with how often they occur: source, doc_id, size, n."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return (
        docs.select("source", "doc_id", size.alias("size"))
        .groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    )


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target: all words shared by weight, none above ``most`` times its source.

    Sharing an excess by weight until nobody is above ends where every source
    has the smaller of its cap and a common level times its weight. The level
    follows from running sums over the sources in order of cap by weight. The
    table has one row per source; the ordering is over that table alone.
    """
    by_source = sized.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n_docs"),
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = by_source.withColumn(
        "weight", F.array(*map(F.lit, weights))[place % len(weights)]
    ).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    table = table.withColumn(
        "level",
        (F.sum("source_size").over(whole)
         - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    )
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(whole)
    return table.withColumn("target", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select(
        "source", "source_size", "n_docs", "target")


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


ITEM = "struct<k:bigint,u:double,doc_id:bigint,nth:bigint,size:bigint,p:double>"


def _with_p(item: Column, p: Column) -> Column:
    return F.struct(*[item[k].alias(k) for k in ("k", "u", "doc_id", "nth", "size")], p.alias("p"))


def _snap(p: Column) -> Column:
    return F.when(p < NEAR, 0.0).when(p > 1 - NEAR, 1.0).otherwise(p)


def _copies(x: Column) -> tuple[Column, Column]:
    """Whole part and fraction of a number of copies, both of one number: almost a whole one is that."""
    near = F.round(x)
    x = F.when(F.abs(x - near) < NEAR, near).otherwise(x)
    return F.floor(x), x - F.floor(x)


def _settled(p: Column) -> Column:
    return (p == 0.0) | (p == 1.0)


def _meet(i: Column, j: Column) -> Column:
    """The two items after mass moved between them; at least one is settled."""
    a, p, b, q = i["size"], i["p"], j["size"], j["p"]
    return let(
        F.struct(F.least(a * (1 - p), b * q).alias("rise"), F.least(a * p, b * (1 - q)).alias("fall")),
        lambda m: let(
            j["u"] * (m["rise"] + m["fall"]) < m["fall"],
            lambda up: F.array(
                _with_p(i, F.when(up, F.when(a * (1 - p) <= b * q, 1.0).otherwise(_snap(p + m["rise"] / a)))
                        .otherwise(F.when(a * p <= b * (1 - q), 0.0).otherwise(_snap(p - m["fall"] / a)))),
                _with_p(j, F.when(up, F.when(a * (1 - p) <= b * q, _snap(q - m["rise"] / b)).otherwise(0.0))
                        .otherwise(F.when(a * p <= b * (1 - q), _snap(q + m["fall"] / b)).otherwise(1.0))),
            ),
        ),
    )


def _round_run(items: Column) -> Column:
    """All items of one run: settled ones, and at most one that is still fractional."""
    none = F.lit(None).cast(ITEM)
    start = F.struct(none.alias("open"), F.array().cast(f"array<{ITEM}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        met = let(_meet(acc["open"], x), lambda two: F.struct(
            F.filter(two, lambda t: ~_settled(t["p"]))[0].alias("open"),
            F.concat(acc["out"], F.filter(two, lambda t: _settled(t["p"]))).alias("out")))
        return F.when(acc["open"].isNull(), F.struct(x.alias("open"), acc["out"].alias("out"))).otherwise(met)

    return F.aggregate(items, start, step, lambda acc: F.concat(
        acc["out"], F.filter(F.array(acc["open"]), lambda t: t.isNotNull())))


def _level(rows: DataFrame, depth: int, block: int) -> DataFrame:
    """One level of the tree; ``width`` bounds how many rows of the source are still open."""
    runs = F.ceil(F.col("width") / block)
    dealt = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "nth", F.lit(2 * depth)), runs))
    item = F.struct((-F.col("size")).alias("k"), _uniform(F.col("doc_id"), F.col("nth"), F.lit(2 * depth + 1)).alias("u"),
                    "doc_id", F.col("nth").cast("long").alias("nth"), "size", "p")
    return (
        dealt.groupBy("source", "width", "run").agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select("source", F.ceil(F.col("width") / block).alias("width"), F.explode(_round_run(F.col("items"))).alias("x"))
        .select("source", "width", "x.doc_id", "x.nth", "x.size", "x.p")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken; one row per row of ``docs``.

    ``docs`` needs doc_id, text and source; other columns are not read. A null
    or empty text has size 0 and is taken 0 times its 0 words. A null source is
    a source, the last in order. Repeated rows are rounded one by one. An empty
    table gives an empty result.
    """
    sized = written(_sized(docs), "sized")
    sources = written(targets(sized, weights, most), "sources")
    n_sources, widest = sources.agg(F.count("*"), F.coalesce(F.max("n_docs"), F.lit(0))).first()
    by_source = sources.withColumnRenamed("source", "of")
    if n_sources <= BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    rows = (
        sized.join(by_source, F.col("source").eqNullSafe(F.col("of")))
        .select("source", "doc_id", "size", "n_docs", "n",
                F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("x"))
        .withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .withColumn("p", _copies(F.col("x"))[1])
        .withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0))
        .select("source", F.col("n_docs").alias("width"), "doc_id", "nth", "size", "p")
    )
    open_ = rows.filter(~_settled(F.col("p")))
    settled = [rows.filter(_settled(F.col("p")))]
    depth = 0
    while widest > 1:
        out = written(_level(open_, depth, block), "level")
        settled.append(out.filter(_settled(F.col("p"))))
        open_ = out.filter(~_settled(F.col("p")))
        widest, depth = -(-widest // block), depth + 1
    settled.append(open_.withColumn("p", F.round("p")))
    every = settled[0]
    for part in settled[1:]:
        every = every.unionByName(part)
    whole = _copies(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))[0]
    return (
        every.join(by_source, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", (whole + F.col("p")).cast("long"))
        .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
    )
