"""How far the sources of a language stand apart, by the shares of their words.

The leading terms of a source are found with a dominance skyband: a term can
only be among the k that stand out most if fewer than k others have at least
its count in the source, at most its count in the language, and an earlier name.
That needs no totals, so partitions keep their skybands in one pass, a tree
merges them, and only what is left is valued and ranked exactly.

Distances between sources are sums over all kept terms. They are taken tile by
tile: two blocks of sources by one bucket of terms, a bounded matrix each; terms
that neither source of a tile has all add the same amount.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cabinlift.llm.scratch import Scratch, few

# Fixed values of the data contract: documents a term must be in, scale of a share, terms listed.
LEAST_DOCS, SCALE, LEADING = 10, 1_000_000_000, 10

#: Distinct (source, term) counts a task holds before it hands them on, and bytes of a text split at a time.
HELD, PIECE = 400_000, 1 << 20
#: Partial skybands merged at once, and rows a task gathers before it takes a skyband.
FAN_IN, GATHERED = 16, 200_000
#: Sources of a block and terms of a bucket, on average.
BLOCK, BUCKET = 128, 4096

#: Letters A-Z as a-z and all bytes of other scripts stay, the rest separates words.
_LETTERS = bytes(
    b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
_BAND = "lang string, source string, term string, n long, total long"


def _pieces(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    data, at = text.encode().translate(_LETTERS), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _handed_on(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        # A row without a term says that the group occurs.
        terms = pa.concat_arrays([pa.nulls(1, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string())])
        yield pa.record_batch([
            pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.repeat(pa.scalar(source, pa.string()), len(terms)), terms,
            pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64()),
        ], ["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, combined within the task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in _pieces(text):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from _handed_on(held)
            held = {}
    yield from _handed_on(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n occurrences, docs documents with it; a null term for every group that occurs."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def skyband(n: np.ndarray, total: np.ndarray, k: int, chunk: int = 512) -> np.ndarray:
    """Mask of the points that fewer than ``k`` earlier ones dominate by n as large and total as small.

    Points come in the order of their names. It is enough to look at the band
    itself: whoever is dominated k times is dominated by k points of the band.
    """
    keep = np.zeros(len(n), bool)
    band_n, band_total, size = np.zeros(64, np.int64), np.zeros(64, np.int64), 0
    for a in range(0, len(n), chunk):
        some = np.arange(a, min(a + chunk, len(n)))
        if size:
            # Per place in the band by falling n, the k-th smallest total up to there.
            order = np.argsort(-band_n[:size], kind="stable")
            least, lowest = np.full(size + 1, np.iinfo(np.int64).max), []
            for i, value in enumerate(band_total[order].tolist(), 1):
                insort(lowest, value)
                del lowest[k:]
                if len(lowest) == k:
                    least[i] = lowest[-1]
            before = np.searchsorted(-band_n[order], -n[some], "right")
            some = some[least[before] > total[some]]
        for i in some.tolist():
            if np.count_nonzero((band_n[:size] >= n[i]) & (band_total[:size] <= total[i])) < k:
                keep[i] = True
                if size == len(band_n):
                    band_n, band_total = np.resize(band_n, 2 * size), np.resize(band_total, 2 * size)
                band_n[size], band_total[size] = n[i], total[i]
                size += 1
    return keep


def _bands(points: pa.Table, k: int) -> pa.Table:
    """The skyband of each group of ``points``."""
    points = points.combine_chunks().sort_by([("lang", "ascending"), ("source", "ascending"), ("term", "ascending")])
    if not points.num_rows:
        return points
    n, total = points.column("n").to_numpy(), points.column("total").to_numpy()
    new = np.zeros(points.num_rows, bool)
    for name in ("lang", "source"):
        column = points.column(name).combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    cuts = [0, *np.flatnonzero(new).tolist(), points.num_rows]
    keep = np.concatenate([skyband(n[a:b], total[a:b], k) for a, b in zip(cuts, cuts[1:])])
    return points.filter(pa.array(keep))


def leading_candidates(entries: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """The rows of ``entries`` in the k-skyband of their lang and source: by partition, then merged in a tree.

    The result is a written table; its column ``part`` means nothing any more.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, fresh, rows = [], [], 0
        for batch in batches:
            fresh.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= GATHERED:
                band, fresh, rows = [_bands(pa.concat_tables(band + fresh), k)], [], 0
        if band or fresh:
            yield from _bands(pa.concat_tables(band + fresh), k).to_batches()

    def merge(key: tuple, part: pa.Table) -> pa.Table:
        band = _bands(part.select(["lang", "source", "term", "n", "total"]), k)
        return band.append_column("part", pa.repeat(key[2].cast(pa.int64()), len(band)))

    bands = entries.select("lang", "source", "term", "n", "total").mapInArrow(local, _BAND)
    bands = scratch.write(bands.withColumn("part", F.spark_partition_id()), "bands")
    last = bands.agg(F.max("part")).first()[0] or 0
    while last:
        grouped = bands.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("lang", "source", "part")
        merged = grouped.applyInArrow(merge, _BAND + ", part long")
        bands, last = scratch.write(merged, "bands"), last // FAN_IN
    return bands


def _share(n: Column, all_n: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (all_n + 2 * kept)), exactly; null where nothing is kept."""
    whole = lambda c: c.cast("decimal(19,0)")
    ratio = F.call_function("div", whole(n + 2) * F.lit(SCALE).cast("decimal(10,0)"), whole(all_n + 2 * kept))
    return F.when(kept > 0, 1 + ratio)


def _apart(p, q):
    """floor((p - q)^2 / (p + q)): shares stay below 2^31, so 64 bits hold it."""
    return (p - q) * (p - q) // (p + q)


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums over the terms of one bucket for every pair of sources of two blocks."""
    lang, left, right, _ = (part.as_py() for part in key)
    is_source = pc.is_null(rows.column("term"))
    sources = rows.filter(is_source).sort_by("source")
    names = sources.column("source").combine_chunks()
    base, block = sources.column("p").to_numpy(), sources.column("block").to_numpy()
    cells = rows.filter(pc.invert(is_source))
    terms = cells.column("term").combine_chunks().dictionary_encode()
    shares = np.repeat(base[None, :], len(terms.dictionary), axis=0)
    place = pc.index_in(cells.column("source").combine_chunks(), names).to_numpy(zero_copy_only=False)
    shares[terms.indices.to_numpy(zero_copy_only=False), place] = cells.column("p").to_numpy()
    out: list[list[np.ndarray]] = [[], [], [], []]
    for a in np.flatnonzero(block == left):
        others = np.arange(a + 1, len(names)) if left == right else np.flatnonzero(block == right)
        both = shares[:, others], shares[:, [a]]
        for found, values in zip(out, (np.full(len(others), a), others, _apart(*both).sum(axis=0), _apart(base[others], base[a]))):
            found.append(values)
    a, b, value, absent = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    return pa.table({
        "lang": pa.repeat(pa.scalar(lang, pa.string()), len(a)), "a": names.take(pa.array(a, pa.int64())),
        "b": names.take(pa.array(b, pa.int64())), "value": pa.array(value, pa.int64()),
        "terms": pa.repeat(pa.scalar(len(shares), pa.int64()), len(a)), "absent": pa.array(absent, pa.int64())})


def _distances(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value of every two sources of a language."""
    group = few(groups)
    cells = entries.select("lang", "source", "term", "n").join(group, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n"), F.col("group_n"), F.col("kept")).alias("p"), "kept", "sources")
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1))
    sources = groups.select(
        "lang", "source", F.lit(None).cast("string").alias("term"),
        F.coalesce(_share(F.lit(0), F.col("group_n"), F.col("kept")), F.lit(1)).cast("long").alias("p"), "kept", "sources")
    sized = lambda df: df.withColumns({
        "blocks": F.ceil(F.col("sources") / BLOCK), "buckets": F.greatest(F.lit(1), F.ceil(F.col("kept") / BUCKET))})
    rows = sized(cells).withColumn("bucket", bucket).unionByName(sized(sources).withColumn("bucket", every))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("lang", "source", "term", "p", "bucket", "block",
                       F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    tiles = rows.groupBy("lang", "left", "right", "bucket").applyInArrow(
        _tile, "lang string, a string, b string, value long, terms long, absent long")
    sums = tiles.groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"), F.sum("terms").alias("terms"), F.max("absent").alias("absent"))
    kept = few(groups.select("lang", "kept").distinct())
    return sums.join(kept, "lang").select("lang", "a", "b", (
        F.col("value") + (F.col("kept") - F.col("terms")) * F.col("absent")).alias("value"))


def divergence_report(docs: DataFrame, least_docs: int = LEAST_DOCS, leading: int = LEADING) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources (part ``pair``) and the leading terms (part ``term``).

    ``docs`` needs text, lang and source; other columns are not read, whatever
    their names. Null counts as ''. A term is a run of letters, A-Z lower-cased;
    a language keeps those in at least ``least_docs`` of its documents (a row
    that repeats counts again). Every (lang, source) that occurs is compared with
    the others of its language, also without a term; where a language keeps no
    term all distances are 0. Ties go to the item that is earlier in UTF-8. An
    empty table gives an empty result. Shares are whole numbers, and all
    arithmetic on them is exact.
    """
    scratch = Scratch()
    counts = scratch.write(term_counts(docs), "counts")
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    entries = scratch.write(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "entries")

    group = counts.select("lang", "source").distinct().join(
        entries.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left")
    langs = entries.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    sizes = group.groupBy("lang").agg(F.count("*").alias("sources"))
    terms = entries.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("kept"))
    lang = sizes.join(langs, "lang", "left").join(terms, "lang", "left")
    groups = scratch.write(group.join(lang, "lang").fillna(0, ["group_n", "lang_n", "kept"]), "groups")

    near = scratch.write(_distances(entries, groups), "distances")
    bands = leading_candidates(entries, leading, scratch)
    scratch.free(near, bands, groups)

    pairs = near.select("lang", "value", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")).select("lang", "x.*", "value")
    p, q = F.col("p"), F.col("q")
    valued = bands.join(few(groups), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        _share(F.col("n"), F.col("group_n"), F.col("kept")).alias("p"),
        _share(F.col("total"), F.col("lang_n"), F.col("kept")).alias("q")).filter(p > q)
    valued = valued.withColumn("value", F.call_function("div", (p - q) * (p - q), p + q))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(valued, "term").filter(F.col("rank") <= leading))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
         coalesce(source, '') AS source FROM documents),
w AS (
  SELECT row, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (
  SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS count, total,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.n + 2 * langs.v) AS p
  FROM kept JOIN langs USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
all_pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (
  SELECT lang, source, term AS item, p, 1 + 1000000000::HUGEINT * (total + 2) // (langs.n + 2 * langs.v) AS q
  FROM shares JOIN langs USING (lang) WHERE count > 0),
valued AS (
  SELECT lang, source, item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM terms WHERE p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM all_pairs
  UNION ALL
  SELECT lang, source, 'term', item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM valued)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
