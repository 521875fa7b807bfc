"""N-gram Jaccard join as a blocked sparse product of documents by n-grams.

Documents with equal sets are one row of the matrix. Columns are n-grams, rare
ones first. A row only enters the columns of its prefix: two sets that link
share a column there. An entry knows its place in its row, which bounds the
overlap that is still possible, so most pairs of a column are discarded by size
and place alone. The product runs in two rounds:

1. every entry of a column meets the column's leader, the entry with the most
   room; links found so far give components;
2. columns that still hold several components are cut into blocks by size, and
   entries of different components meet within the bounds.

Pairs inside a component need no second look, so a large group of near copies
costs one comparison a copy. Overlaps found in the prefix columns are added up
per pair, and pairs go whose sum leaves too little for what comes after. A parity
sketch of each set, as long as its size asks for, bounds from below in how many
n-grams two sets differ, and discards pairs that differ in too many; for the few
others, overlaps are counted over whole sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cabinlift.llm import grams
from cabinlift.llm.components import components
from cabinlift.llm.scratch import Scratch, few

# Words per shingle and least similarity in per cent, of the data contract.
WORDS = 4
PERCENT = 85

#: How many frequent n-grams are told apart when columns are ordered; more or fewer changes the cost only.
FREQUENT = 1 << 20
#: N-grams gathered in a task before it counts which of them repeat.
COUNTED = 2_000_000
#: Growth of set sizes from one block of a column to the next, and rows per block that are split further.
BAND, BLOCK_ROWS = 1.05, 2_000
#: Longs of the shortest sketch; larger sets have longer ones, at least a bit per n-gram.
SKETCH = 16


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles of n words, sorted; shorter texts are one shingle as a whole."""
    words = grams.Words(batch.column("text"), grams.SPACED)
    shingles = words.grams(n)
    for a, b in zip(words.bounds.tolist(), words.bounds[1:].tolist()):
        if b - a >= n:
            yield np.unique(shingles[a:b - n + 1])
        elif b > a:
            whole = np.uint64(b - a) + (words.hash[a:b] * grams.powers(64)[1:b - a + 1]).sum(dtype=np.uint64)
            yield grams.mixed(np.array([whole]))
        else:
            yield np.zeros(0, np.uint64)


def _repeated(n: int):
    """Arrow function: n-grams that several different texts of a task share, with counts."""

    def counted(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = np.concatenate(sets)
        sets.clear()  # sorted in place, so a task holds the n-grams once
        values.sort()
        third = values[2:][values[2:] == values[:-2]]  # the third copy of each and those after it
        kept, counts = np.unique(third, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept.view(np.int64)), pa.array(counts.astype(np.int64) + 2)], names=["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()
        for batch in grams.slices(batches):
            for one in _sets(batch, n):
                key = (len(one), one[:4].tobytes())
                if key in seen:
                    continue
                seen.add(key)
                held.append(one)
                total += len(one)
            if total > COUNTED:
                yield from counted(held)
                held, total, seen = [], 0, set()
        if held:
            yield from counted(held)

    return run


def _frequent(docs: DataFrame, n: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """At most ``FREQUENT`` n-grams and how often they were seen; only the order of columns depends on it."""
    counts = scratch.write(
        docs.select("text").mapInArrow(_repeated(n), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("bits")).count().orderBy(F.desc("bits")).collect()
    total, least = 0, 64
    for bits, size in sizes:
        if total + size > FREQUENT:
            break
        total, least = total + size, bits
    table = counts.filter(F.floor(F.log2("n")).cast("int") >= least).toPandas().sort_values("gram")
    values = table["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], table["n"].to_numpy(np.int64)[order]


def _sketch(one: np.ndarray) -> np.ndarray:
    """Bit h is the parity of the n-grams that hash to h: two sketches differ in no more bits than their sets in n-grams.

    Its length is a power of two times ``SKETCH``; folded by halves it is the shorter sketch of the same set.
    """
    bits = 64 * SKETCH << max(0, (len(one) - 1).bit_length() - (64 * SKETCH - 1).bit_length())
    odd = np.bincount((one % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _prefixer(n: int, percent: int, frequent):
    """Arrow function: doc_id, set size, digest and sketch of the set, and its prefix with the rarest n-grams first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = frequent.value
        for batch in grams.slices(batches):
            sizes, digests, sketches, prefixes = [], [], [], []
            for one in _sets(batch, n):
                sizes.append(len(one))
                sketches.append(_sketch(one))
                digests.append(hashlib.blake2b(one.tobytes(), digest_size=16).digest())
                if len(known) and len(one):
                    at = np.minimum(np.searchsorted(known, one), len(known) - 1)
                    count = np.where(known[at] == one, often[at], 0)
                    if count.any():
                        one = one[np.argsort(count, kind="stable")]
                prefixes.append(one[:len(one) - (percent * len(one) + 99) // 100 + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(sketches, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "n", "digest", "sketch", "prefix"])

    return run


def _whole_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grams.slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("b"), pa.array([s.view(np.int64) for s in _sets(batch, n)], pa.list_(pa.int64()))],
                names=["node", "b", "shingles"])

    return run


def _room(percent: int, ni: Column, pi: Column, nj: Column, pj: Column) -> Column:
    """Whether two entries of a column can still reach the overlap that their sizes ask for."""
    return F.least(ni - pi, nj - pj) * (100 + percent) >= percent * (ni + nj)


def _likely(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave it open that the sets link; a node may have several sets."""
    side = lambda x: heads.select(F.col("doc_id").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("sketch" + x))
    xor = lambda x, y: x.bitwiseXOR(y)
    size = F.least(F.size("sketcha"), F.size("sketchb"))

    def folded(sketch: str) -> Column:
        parts = lambda i: F.transform(F.sequence(i, F.size(sketch) - 1, size), lambda j: F.get(sketch, j))
        longer = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(parts(i), F.lit(0).cast("long"), xor))
        return F.when(F.size(sketch) == size, F.col(sketch)).otherwise(longer)

    differing = F.aggregate(
        F.zip_with(folded("sketcha"), folded("sketchb"), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda total, x: total + x)
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .filter(differing * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b").distinct()
    )


def _linked(pairs: DataFrame, docs: DataFrame, words: int, percent: int, once: bool) -> DataFrame:
    """The pairs (a, b) whose whole sets overlap enough.

    ``pairs`` is a written table. While it is small, the sets of a are made where
    their texts are read and sent once per pair, those of b once each; without
    ``once`` equal sets under one id are told apart.
    """
    ids = few(pairs.select(F.col("b").alias("node")).distinct())
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    left = texts.join(few(pairs), F.col("node") == F.col("a")).select("node", "b", "text").mapInArrow(
        _whole_sets(words), "node long, b long, shingles array<long>")
    right = texts.join(ids, "node", "left_semi").select("node", F.lit(None).cast("long").alias("b"), "text").mapInArrow(
        _whole_sets(words), "node long, b long, shingles array<long>")
    left = left.select(F.col("node").alias("a"), "b", F.col("shingles").alias("sa"))
    right = right.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    if not once:  # repeated rows would repeat each link
        left, right = left.dropDuplicates(), right.dropDuplicates()
    shared = F.size(F.array_intersect("sa", "sb"))
    return (
        left.join(right, "b").withColumn("shared", shared)
        .filter(F.col("shared") * 100 >= percent * (F.size("sa") + F.size("sb") - F.col("shared")))
        .select("a", "b")
    )


def _blocks(entries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the second round, keyed by column, size band and sub-block.

    The smaller set of a linked pair has its entry among the first places, as
    far as a partner of its own size could be reached; the larger one looks for
    it in the bands of all sizes that are similar enough, up to the size that
    the rest of its own row, from its place on, could still make up for.
    """
    band = lambda size: F.floor(F.log(size.cast("double")) / math.log(BAND)).cast("int")
    n, pos = F.col("n"), F.col("pos")
    index = entries.filter((n - pos) * (100 + percent) >= 2 * percent * n).withColumn("band", band(n))
    parts = index.groupBy("gram", "band").agg((F.floor(F.count("*") / BLOCK_ROWS) + 1).cast("int").alias("parts"))
    index = index.join(parts, ["gram", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    most = F.least(n, F.floor((n - pos) * (100 + percent) / percent) - n)  # at least the least similar size, in a prefix
    probes = (
        entries.withColumn("band", F.explode(F.sequence(band(F.ceil(n * percent / 100)), band(most))))
        .join(parts, ["gram", "band"])
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    names = lambda df, mark: df.select(
        "gram", "band", "part", *[F.col(c).alias(c + mark) for c in ("node", "n", "pos", "component")])
    return names(index, "_i"), names(probes, "_p")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id; one row per row of ``docs``.

    Two texts link when ``100 * shared >= percent * union`` of their sets of
    lower-cased shingles; the component is the smallest doc_id reachable.
    ``docs`` needs doc_id and text; other columns are not read. Texts without
    words, empty or null, have no shingles and link with nothing. Repeated rows
    are copies of each other. Rows without a doc_id take no part and get a null
    component. An empty table gives an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = spark.sparkContext.broadcast(_frequent(docs, words, scratch))
    prefixes = scratch.write(docs.mapInArrow(
        _prefixer(words, percent, frequent), "doc_id long, n long, digest binary, sketch array<long>, prefix array<long>"), "prefixes")
    rows = scratch.write(prefixes.drop("sketch", "prefix"), "rows")
    real = prefixes.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = scratch.write(real.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")), "classes")

    # Only sets that several rows hold are looked up: the row of a set held once is its head.
    # A document id that occurs with several texts is a node for each; one id joins them.
    copied = few(scratch.write(classes.filter("rows > 1").select("digest", "node"), "copied"))
    heads = real.join(copied, "digest", "left").filter(F.col("node").isNull() | (F.col("doc_id") == F.col("node"))).drop("node")
    repeats = not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if repeats:  # a row that is there twice is one node
        heads = heads.dropDuplicates(["doc_id", "digest"])
    heads = scratch.write(heads, "heads")
    scratch.free(rows, classes, heads)
    entries = heads.select(F.col("doc_id").alias("node"), "n", F.posexplode("prefix").alias("pos", "gram"))
    rank = F.shiftleft(F.col("pos").cast("long"), 33) + F.pmod(F.xxhash64("node"), F.lit(1 << 33))
    columns = scratch.write(entries.groupBy("gram").count().filter("count > 1").select("gram"), "columns")
    # Size and place travel as one number: this shuffle is the widest.
    packed = entries.select("gram", "node", (F.shiftleft("n", 32) + F.col("pos")).alias("place"))
    shared = scratch.write(packed.join(columns, "gram", "left_semi").select(
        "gram", "node", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(0xFFFFFFFF).alias("pos")), "shared")
    sketches = scratch.write(heads.select("doc_id", "n", "sketch"), "sketches")
    scratch.free(rows, classes, shared, sketches)
    leads = (
        shared.withColumn("rank", rank).groupBy("gram")
        .agg(F.min_by("node", "rank").alias("lead"), F.min_by("n", "rank").alias("lead_n"), F.min_by("pos", "rank").alias("lead_pos"))
    )
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = shared.join(leads, "gram").filter(
        (F.col("node") != F.col("lead")) & _room(percent, F.col("n"), F.col("pos"), F.col("lead_n"), F.col("lead_pos"))
    ).select(*pair("node", "lead")).distinct()
    first = scratch.write(first, "first")

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs that link, by the whole sets of just the documents in them."""
        own = Scratch()
        pairs = own.write(_likely(pairs, sketches, percent), "likely")
        found = scratch.write(_linked(pairs, docs, words, percent, not repeats).distinct(), "links")
        own.free()
        return found

    links = checked(first)
    found = components(links)

    labelled = (
        shared.select("gram", "node", "n", "pos").join(found, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    labelled = scratch.write(labelled, "labelled")
    split = labelled.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    index, probes = _blocks(scratch.write(labelled.join(split.select("gram"), "gram", "left_semi"), "split"), percent)
    second = index.join(probes, ["gram", "band", "part"]).filter(
        (F.col("component_i") != F.col("component_p"))
        & ((F.col("n_i") < F.col("n_p")) | ((F.col("n_i") == F.col("n_p")) & (F.col("node_i") < F.col("node_p"))))
        & _room(percent, F.col("n_i"), F.col("pos_i"), F.col("n_p"), F.col("pos_p"))
    )
    sides = ["node_i", "node_p", "n_i", "n_p"]
    met = second.groupBy(*sides).agg(F.count("*").alias("met"), F.max("pos_i").alias("last_i"), F.max("pos_p").alias("last_p"))
    if not repeats:  # columns are met in their order, so what is still to come lies behind the last one
        rest = F.least(F.col("n_i") - F.col("last_i"), F.col("n_p") - F.col("last_p")) - 1
        met = met.filter((F.col("met") + rest) * (100 + percent) >= percent * (F.col("n_i") + F.col("n_p")))
    second = met.select(*pair("node_i", "node_p")).distinct().join(first, ["a", "b"], "left_anti")
    found = components(links.unionByName(checked(scratch.write(second, "second"))))
    scratch.free(rows, classes)
    named = (
        classes.join(found, "node", "left")
        .select("digest", F.coalesce("component", "node").alias("component"))
    )
    of = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return rows.join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), of.alias("component_id"))
