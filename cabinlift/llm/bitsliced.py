"""Exact search for the largest inner products with a bit-sliced index.

A block of whole-number vectors is kept as bitmaps: one per attribute and bit,
with a bit per row. A query adds the slices of all attributes, weighted by its
own components, with bitmap arithmetic alone: weights are split into powers of
two, negative ones take the complement, and carry-save adders turn all bitmaps
of a place into one sum and carries of the next. The low slices of wide
attributes are left out, so the sums are quantised and their error has a bound.

The best rows are then selected from the most significant slice of the sums
downward. Every row that the bound still allows among the best is looked up and
scored exactly, so the result is exact whatever the number of slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the data contract: scale of a component, queries, result size.
SCALE, QUERY_STEP, NEAREST = 256, 50, 5

#: Slices added per attribute; more of them are slower to add but leave fewer rows to look up.
SLICES = 6
#: Vectors and queries of a cell at most; few vectors are cut finer, down to FINEST, so that all cores have some.
DATA_BLOCK, QUERY_BLOCK, FINEST = 16_384, 16_384, 1_024
#: Whole numbers up to here are exact in 64 bits; larger scores are added as Python integers.
EXACT = 1 << 62


def _added(bitmaps: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """The sum of numbers given by the bitmaps of each place, as slices from the least place up."""
    out, place = [], 0
    while bitmaps:
        stack = np.concatenate(bitmaps.pop(place, [np.zeros((1, words), np.uint64)]))
        carries = []
        while len(stack) > 1:
            third = max(1, len(stack) // 3)
            a, b = stack[:third], stack[third:2 * third]
            if len(stack) == 2:
                carries.append(a & b)
                stack = a ^ b
                break
            c, rest = stack[2 * third:3 * third], stack[3 * third:]
            half = a ^ b
            carries.append((a & b) | (half & c))
            stack = np.concatenate((half ^ c, rest))
        out.append(stack[0])
        place += 1
        if carries:
            bitmaps.setdefault(place, []).extend(carries)
    return out


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


class BitSlicedIndex:
    """Bitmaps of the whole-number vectors ``x``, one row each."""

    def __init__(self, x: np.ndarray, slices: int = SLICES) -> None:
        self.x, (self.rows, dim) = x, x.shape
        low = x.min(axis=0) if dim else np.zeros(0, x.dtype)
        above = x - low
        width = int(above.max()).bit_length() if dim else 0
        self.shift, self.width = max(0, width - slices), min(width, slices)
        self.words = -(-self.rows // 64)
        self.bits = np.zeros((self.width, dim, self.words), np.uint64)
        for k in range(self.width):
            on = ((above >> (self.shift + k)) & 1).astype(bool)
            packed = np.zeros((dim, self.words * 8), np.uint8)
            packed[:, :-(-self.rows // 8)] = np.packbits(on.T, axis=1, bitorder="little")
            self.bits[k] = packed.view(np.uint64)
        full = np.zeros(self.words * 8, np.uint8)
        full[:-(-self.rows // 8)] = np.packbits(np.ones(self.rows, bool), bitorder="little")
        self.all = full.view(np.uint64)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the quantised scores, up to a constant of the query."""
        weights = [abs(int(q)) for q in query]
        flip = np.array([np.uint64(0xFFFFFFFFFFFFFFFF) if q < 0 else np.uint64(0) for q in query], np.uint64)
        bitmaps: dict[int, list[np.ndarray]] = {}
        for place in range(max(weights, default=0).bit_length()):
            has = np.flatnonzero([w >> place & 1 for w in weights])
            if len(has):
                for k in range(self.width):
                    bitmaps.setdefault(place + k, []).append(self.bits[k][has] ^ flip[has, None])
        return _added(bitmaps, self.words)

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best, ties with the last included."""
        if self.rows <= k:
            return np.arange(self.rows)
        slices = self.sums(query)
        # From the top slice down: the value of the k-th largest sum.
        sure, open_, kth = 0, self.all, 0
        for place in range(len(slices) - 1, -1, -1):
            on = open_ & slices[place]
            n = _count(on)
            if sure + n >= k:
                open_, kth = on, kth | 1 << place
            else:
                sure, open_ = sure + n, open_ & ~slices[place]
        # What the left-out slices may add, in units of the lowest one that was added.
        slack = ((1 << self.shift) - 1) * sum(abs(int(q)) for q in query)
        least = max(0, kth - (slack >> self.shift))
        above, equal = np.zeros_like(self.all), self.all
        for place in range(len(slices) - 1, -1, -1):
            if least >> place & 1:
                equal = equal & slices[place]
            else:
                above, equal = above | (equal & slices[place]), equal & ~slices[place]
        bits = np.unpackbits((above | equal).view(np.uint8), count=self.rows, bitorder="little")
        return np.flatnonzero(bits)

    def best(self, query: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows, ties to the smaller id."""
        some = self.candidates(query, k)
        scores = (self.x[some] * query).sum(axis=1)
        return sorted(zip(ids[some].tolist(), map(int, scores)), key=lambda hit: (-hit[1], hit[0]))[:k]


def _whole(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """floor(SCALE * x) of all components; Python integers where 64 bits may not hold a score."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    floors = np.floor(flat * SCALE).reshape(len(column), dim)
    most = float(np.abs(floors).max()) if floors.size else 0.0
    if most * most * max(dim, 1) < EXACT:
        return floors.astype(np.int64)
    return np.array([[int(v) for v in row] for row in floors.tolist()], object).reshape(floors.shape)


def _cell(k: int):
    """Arrow function over one cell: the k best of its vectors for each of its queries."""

    def run(key: tuple, data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if data.num_rows and queries.num_rows:
            dim, ids = key[0].as_py(), data.column("vec_id").to_numpy()
            x, asked = _whole(data.column("v"), dim), _whole(queries.column("v"), dim)
            if object in (x.dtype, asked.dtype):
                x, asked = x.astype(object), asked.astype(object)
            index = BitSlicedIndex(x)
            # Rows of the query's own id are skipped, so as many more are asked for.
            names, times = np.unique(ids, return_counts=True)
            times = dict(zip(names.tolist(), times.tolist()))
            for name, mark, query in zip(queries.column("vec_id").to_pylist(), queries.column("mark").to_pylist(), asked):
                hits = [hit for hit in index.best(query, ids, k + times.get(name, 0)) if hit[0] != name][:k]
                for found, score in hits:
                    for col, value in zip(out, (name, mark, found, max(-(1 << 63), min((1 << 63) - 1, score)))):
                        col.append(value)
        return pa.table(dict(zip(("query_id", "mark", "vec_id", "score"), (pa.array(x, pa.int64()) for x in out))))

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v, dim, mark of the distinct vectors that take part; ``mark`` tells apart those of one id."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).distinct()
    return rows.select("vec_id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("mark"))


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of floor(256 x), ties to the smaller id.

    Both tables need vec_id and embedding; other columns are not read. Vectors
    that are null or hold null or non-finite components, and rows without an id,
    take no part; vectors without components score 0. A query never finds its
    own id; with fewer than k others it finds them all. Vectors of different
    length do not meet. A row that repeats an id and vector counts once;
    different vectors under one id are ranked one by one, as queries too.
    Scores beyond 64 bits are cut to the largest number that fits.
    """
    data, asked = usable(vectors), usable(queries)
    n, q = vectors.count(), queries.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // DATA_BLOCK), min(cores, n // FINEST))
    query_blocks = max(1, -(-q // QUERY_BLOCK))
    spread = lambda df, col, own, other: (
        df.withColumn(col, F.pmod(F.xxhash64("vec_id", "mark"), F.lit(own)).cast("int"))
        .withColumn(other[0], F.explode(F.sequence(F.lit(0), F.lit(other[1] - 1)))))
    keys = ("dim", "block", "query_block")
    # Cells are small to send and long to work on, so they are dealt to more tasks than their size asks for.
    tasks = min(blocks * query_blocks, 64 * cores)
    data = spread(data, "block", blocks, ("query_block", query_blocks)).repartition(tasks, *keys)
    asked = spread(asked, "query_block", query_blocks, ("block", blocks)).repartition(tasks, *keys)
    near = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        _cell(k), "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def product_report(vectors: DataFrame) -> DataFrame:
    """The best of every vector whose id is divisible by ``QUERY_STEP``, among all vectors."""
    return search(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0))


ORACLE = """
WITH fit AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])), 0)::BIGINT AS score
  FROM fit q JOIN fit d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
