"""Benchmark decontamination by winnowing.

Of every `WINDOW - K + 1` neighbouring hashes of K words the smallest is a
fingerprint, in documents and in benchmark items alike. A passage of WINDOW
words that both share holds the same such neighbours in both, so it shares a
fingerprint at the same place: no shared window is missed. Equal fingerprints
are joined, compared word by word and extended to both sides; extensions of
WINDOW words or more are hits. Items of fewer words are looked up as a whole.

Documents are grouped by the digest of their text, so copies are compared once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cabinlift.llm import grams
from cabinlift.sources.shared import written

# The words of a window, and hit words per word (1 of 20) from which a document counts as contaminated.
WINDOW = 13
SHARE = 20

#: Words per hash. Larger hashes are rarer by chance; smaller ones leave fewer fingerprints.
K = 8
#: Bits per fingerprint in the prefilter, and its bounds; the join behind it is exact at any size.
BITS, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 30
#: Item fingerprints up to which they are broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 100_000

_SEPARATORS = bytes(b if grams.ALNUM[b] else 32 for b in range(256))
_FOUND_TYPE = pa.list_(pa.struct([("fp", pa.int64()), ("k", pa.int32()), ("at", pa.int64()), ("back", pa.int32()), ("ctx", pa.string())]))
_FOUND_SQL = "array<struct<fp:bigint,k:int,at:bigint,back:int,ctx:string>>"


def _winnow(words: grams.Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words, and the word numbers of the fingerprints."""
    hashes = words.grams(k)
    width = window - k + 1
    if len(hashes) < width:
        return hashes, np.zeros(0, np.int64)
    near = np.lib.stride_tricks.sliding_window_view(hashes, width)
    lowest = width - 1 - np.argmin(near[:, ::-1], axis=1)  # the last of equals
    ends = np.repeat(words.bounds[1:], np.diff(words.bounds))
    own = np.flatnonzero(np.arange(len(near)) + window <= ends[:len(near)])
    return hashes, np.unique(own + lowest[own])


def _context(words: grams.Words, text: int, at: int, k: int, window: int) -> tuple[int, str]:
    """How many words stand before ``at`` in the excerpt, and the excerpt: all that a window around can hold."""
    first = max(int(words.bounds[text]), at - (window - k))
    last = min(int(words.bounds[text + 1]), at + window) - 1
    return at - first, b" ".join(words.text(first, last).lower().translate(_SEPARATORS).split()).decode()


def _fingerprinter(window: int, k: int, lengths: list[int] | None, bitmap):
    """Arrow function: the id column, digest, words and fingerprints of each row.

    ``lengths`` are the sizes of short items to look up at every word; None
    marks the benchmark itself, whose short items give one fingerprint each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value if bitmap else None
        for batch in grams.slices(batches):
            column = batch.column("text")
            words = grams.Words(column, grams.ALNUM)
            counts = np.diff(words.bounds)
            hashes, places = _winnow(words, window, k)
            picked = [(k, places, hashes[places])]
            if lengths is None:
                for n in np.unique(counts[(counts > 0) & (counts < window)]):
                    own = words.bounds[:-1][counts == n]
                    picked.append((int(n), own, words.grams(int(n))[own]))
            else:
                ends = np.repeat(words.bounds[1:], counts)
                for n in lengths:
                    every = words.grams(n)
                    own = np.flatnonzero(np.arange(len(every)) + n <= ends[:len(every)])
                    picked.append((n, own, every[own]))
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for n, own, values in picked:
                if bits is not None and len(values):
                    slot = values & np.uint64(len(bits) * 64 - 1)
                    keep = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                    own, values = own[keep], values[keep]
                texts = np.searchsorted(words.bounds, own, side="right") - 1
                for text, at, value in zip(texts.tolist(), own.tolist(), values.view(np.int64).tolist()):
                    back, ctx = _context(words, text, at, n, max(window, n))
                    found[text].append({"fp": value, "k": n, "at": at - int(words.bounds[text]), "back": back, "ctx": ctx})
            digests = [hashlib.blake2b(words.data[a:b], digest_size=16).digest()
                       for a, b in zip(words.text_bounds, words.text_bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(found, _FOUND_TYPE)],
                names=["id", "digest", "n_words", "found"])

    return run


_ROWS = f"id long, digest binary, n_words long, found {_FOUND_SQL}"


def _bitmap(items: DataFrame, count: int):
    """One bit per item fingerprint, folded by Spark into at most ``MOST_BITS`` bits, for all tasks."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, count * BITS):
        bits *= 2
    slot = F.col("fp").bitwiseAND(F.lit(bits - 1))
    cells = (
        items.select(F.shiftright(slot, 6).alias("cell"), F.expr(f"shiftleft(1L, cast((fp & {bits - 1}L) & 63 as int))").alias("bit"))
        .groupBy("cell").agg(F.bit_or("bit").alias("bit")).toPandas()
    )
    table = np.zeros(bits // 64, np.uint64)
    table[cells["cell"].to_numpy(np.int64)] = cells["bit"].to_numpy(np.int64).view(np.uint64)
    return items.sparkSession.sparkContext.broadcast(table)


def _extender(window: int):
    """Arrow function: joined fingerprints to hits (digest, item_id, s, e) in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for r in batch.to_pylist():
                a, b, i, j, k = r["ctx"].split(" "), r["item_ctx"].split(" "), r["back"], r["item_back"], r["k"]
                if a[i:i + k] != b[j:j + k]:
                    continue
                left = 0
                while left < min(i, j) and a[i - left - 1] == b[j - left - 1]:
                    left += 1
                right = k
                while i + right < len(a) and j + right < len(b) and a[i + right] == b[j + right]:
                    right += 1
                if left + right >= min(window, r["item_words"]):
                    for col, value in zip(out, (r["digest"], r["item_id"], r["at"] - left, r["at"] + right)):
                        col.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), *(pa.array(c, pa.int64()) for c in out[1:])],
                names=["digest", "item_id", "s", "e"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` (doc_id, digest, n_words), and per hit (digest, item_id, s, e) in words.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other
    columns are not read. Null and empty texts have no words and no hits.
    Items without an id are left out; rows that repeat an id are one item.
    """
    source = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("id"), "text")
    items = written(
        source.mapInArrow(_fingerprinter(window, k, None, None), _ROWS)
        .select("id", "n_words", F.explode("found").alias("x")).select(F.col("id").alias("item_id"), F.col("n_words").alias("item_words"), "x.fp", "x.k", F.col("x.back").alias("item_back"), F.col("x.ctx").alias("item_ctx"))
        .distinct(), "items")
    count = items.count()
    short = sorted(r[0] for r in items.filter(F.col("item_words") < window).select("item_words").distinct().collect())
    rows = written(
        docs.select(F.col("doc_id").alias("id"), "text")
        .mapInArrow(_fingerprinter(window, k, short, _bitmap(items, count)), _ROWS), "fingerprints")
    probes = (
        rows.select("digest", F.explode("found").alias("x")).select("digest", "x.*")
        .dropDuplicates(["digest", "fp", "k", "at"])
    )
    hits = probes.join(F.broadcast(items) if count <= BROADCAST_ROWS else items, ["fp", "k"]).select(
        "digest", "at", "back", "ctx", "k", "item_id", "item_words", "item_back", "item_ctx",
    ).mapInArrow(_extender(window), "digest binary, item_id long, s long, e long")
    return rows.select(F.col("id").alias("doc_id"), "digest", "n_words"), hits.distinct()


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per document row."""
    rows, hits = contamination(docs, benchmark, window)
    hits = written(hits, "hits")
    order = Window.partitionBy("digest").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        hits.select("digest", "s", "e").distinct()
        .withColumn("done", F.coalesce(F.max("e").over(order), F.lit(0)))
        .groupBy("digest").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "done"))).alias("n_hit"))
    )
    ids = hits.groupBy("digest").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    return (
        rows.join(covered, "digest", "left").join(ids, "digest", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))
    )
