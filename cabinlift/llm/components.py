"""Connected components of a graph that is only ever held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cabinlift.llm.scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free digest: equal states are equal tables but for a 64-bit chance."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node id that is reachable, for every node on an edge.

    Alternating star contraction. Each round hangs every node's larger
    neighbours, then its smaller ones, on the smallest node it sees; the number
    of rounds grows with the logarithm of the longest path. A node's neighbours
    are never gathered: they meet their minimum in a join. Null ids, loops and
    repeated edges are ignored.
    """
    pairs = edges.filter((F.col(a) != F.col(b))).select(
        F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct()
    scratch = Scratch()
    now = scratch.write(pairs, "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        now = scratch.write(small.select("x.u", "x.v").filter(F.col("u") != F.col("v")).distinct(), "edges")
        before, state = state, _state(now)
        scratch.free(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
