"""Approximate nearest neighbours by collision counting over sorted projections.

Every block of vectors is indexed by projections onto single directions, each a
sorted array. A query opens a window around its own projection in all of them
and widens the windows step by step (virtual rehashing: no step needs another
index). A vector that lies in enough windows at once is a candidate; widening
ends when the block has given its share of candidates, and candidates are
compared exactly. Equal vectors of a block are indexed once.

All queries meet all blocks, in cells of bounded size; only the nearest few of
a cell go on. Directions are orthonormal in groups, drawn from a fixed seed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The queries and result size of the data contract.
QUERY_STEP, NEAREST = 50, 5

#: Projections, share of them that must collide, first half-width, growth, and the share of a block to compare.
PROJECTIONS, COLLIDE, FIRST, GROWTH, SHARE = 64, 0.72, 0.5, 1.08, 0.12
#: Vectors and queries of a cell.
DATA_BLOCK, QUERY_BLOCK = 8_192, 4_096
SEED = 20240


def directions(dim: int, count: int) -> np.ndarray:
    """``count`` directions of length sqrt(dim), orthogonal in groups of ``dim``."""
    random = np.random.default_rng(SEED)
    groups = [np.linalg.qr(random.normal(size=(dim, dim)))[0] * np.sqrt(dim) for _ in range(-(-count // dim))]
    return np.hstack(groups)[:, :count]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


class Index:
    """Sorted projections of the distinct vectors of a block."""

    def __init__(self, x: np.ndarray, count: int = PROJECTIONS) -> None:
        self.x, self.norms = x, _lengths(x)
        self.turn = directions(x.shape[1], count)
        places = (x / self.norms[:, None]) @ self.turn
        self.order = np.argsort(places, axis=0).T.copy()
        self.places = np.take_along_axis(places.T, self.order, axis=1)

    def candidates(self, at: np.ndarray, least: int) -> np.ndarray:
        """Vectors that collide often enough, at least ``least`` of them, for a query projected to ``at``."""
        n, m = len(self.x), len(at)
        if n <= least:
            return np.arange(n)
        counts, half, need = np.zeros(n, np.int64), FIRST, int(np.ceil(COLLIDE * m))
        low = np.array([np.searchsorted(p, a) for p, a in zip(self.places, at)])
        high = low.copy()
        while True:
            fresh = []
            for j in range(m):
                a = self.places[j].searchsorted(at[j] - half)
                b = self.places[j].searchsorted(at[j] + half, "right")
                fresh += (self.order[j, a:low[j]], self.order[j, high[j]:b])
                low[j], high[j] = min(a, low[j]), max(b, high[j])
            counts += np.bincount(np.concatenate(fresh), minlength=n)
            found = np.flatnonzero(counts >= need)
            if len(found) >= least:
                return found
            half *= GROWTH

    def nearest(self, query: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best distinct vectors and their exact cosines; all vectors that tie with the last are in."""
        some = self.candidates(at, k + 1 + int(SHARE * len(self.x)))
        scores = (self.x[some] * query).sum(axis=1) / (self.norms[some] * np.sqrt((query * query).sum()))
        if len(scores) > k + 1:
            keep = scores >= np.partition(scores, -(k + 1))[-(k + 1)]
            some, scores = some[keep], scores[keep]
        return some, scores


def _cell(k: int):
    """Arrow function over one cell: the k nearest of its vectors for each of its queries."""

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if data.num_rows and queries.num_rows:
            ids = data.column("vec_id").to_numpy()
            distinct, group = np.unique(_matrix(data.column("v")), axis=0, return_inverse=True)
            by = np.lexsort((ids, group.ravel()))
            first = np.searchsorted(group.ravel()[by], np.arange(len(distinct) + 1))
            index = Index(distinct)
            asked, names = _matrix(queries.column("v")), queries.column("vec_id").to_numpy()
            spots = (asked / _lengths(asked)[:, None]) @ index.turn
            for name, query, at in zip(names.tolist(), asked, spots):
                hits = []
                for g, score in zip(*index.nearest(query, at, k)):
                    # Of equal vectors the smallest ids can be among the nearest.
                    own = np.unique(ids[by[first[g]:first[g + 1]]])
                    hits += [(-score, i) for i in own[own != name][:k].tolist()]
                for score, i in sorted(hits)[:k]:
                    for col, value in zip(out, (name, i, -score)):
                        col.append(value)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v, dim of the vectors that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)
    ).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"))


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query, by cosine, ties to the smaller id.

    Both tables need vec_id and embedding; other columns are not read. Vectors
    that are null, zero or hold null or non-finite components, and rows without
    an id, take no part. A query never finds its own id; with fewer than k
    others it finds them all. Vectors of different length do not meet. A row
    that repeats an id and vector counts once. Recall against brute force is
    measured in the tests.
    """
    data, asked = usable(vectors), usable(queries)
    n, q = data.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // DATA_BLOCK)), max(1, -(-q // QUERY_BLOCK))
    spread = lambda df, col, own, other: (
        df.withColumn(col, F.pmod(F.xxhash64("vec_id", F.lit(col)), F.lit(own)).cast("int"))
        .withColumn(other[0], F.explode(F.sequence(F.lit(0), F.lit(other[1] - 1)))))
    keys = ("dim", "block", "query_block")
    data = spread(data, "block", blocks, ("query_block", query_blocks))
    asked = spread(asked, "query_block", query_blocks, ("block", blocks))
    near = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        _cell(k), "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def neighbour_report(vectors: DataFrame) -> DataFrame:
    """The nearest of every vector whose id is divisible by ``QUERY_STEP``, among all vectors."""
    return search(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0))
