"""Line dedup by a segment-partition edit join.

Lines within ``edits`` edits of each other count as the same; short lines must be
equal and are told by their hash alone. A longer line is cut into
``edits + 1`` segments; a line that is reached by that many edits keeps one of
them whole, at a place that moves by few characters. So every line enters its
own segments in an index and looks up the substrings that a segment of a line
of its length or a little less could have become. Lines that meet are compared
by a banded bit-parallel edit distance.

Equal lines are one line throughout. As in the n-gram join, lines of a segment
first meet the segment's leader, and only lines of different components meet
each other; a 64-bit parity sketch of character pairs, of which an edit flips
four bits at most, discards pairs before they are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cabinlift.llm.columns import let
from cabinlift.llm.components import components
from cabinlift.llm.grams import mixed, slices
from cabinlift.llm.scratch import BROADCAST_ROWS, Scratch, few, unused

#: Edits up to which two lines are the same.
EDITS = 2
#: Code points from which near lines are looked for; two edits change the sense of a shorter one, which must be equal.
LEAST_CHARS = 40
#: Blanks at the ends of a line that do not count.
BLANKS = " \t\r"
#: Shorter lines that stay wherever they recur: one bare word or number, as in a list or a table, without a mark or
#: blank. Scripts that are written without blanks are no single words.
WORD = r"^[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]]+$"
#: Index rows of a segment that meet probes in one block.
BLOCK_ROWS = 2_000
#: Line numbers in all up to which the lines to drop are broadcast.
BROADCAST_DROPS = 2_000_000
#: Pairs compared side by side, and characters of a side in all.
PAIRS, CHARS = 512, 1 << 21


def _lines(docs: DataFrame, least: int, short: bool = False) -> DataFrame:
    """doc_id, body (hash of the text), no, line (hash), s: every line from ``least`` on, or with the ``short`` that count."""
    s = F.trim(F.col("raw"), F.lit(BLANKS))
    counts = F.length("s") >= least
    if short:
        counts = counts | (F.col("s") != "") & ~F.col("s").rlike(WORD)
    return (
        docs.filter(F.col("text").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("body"), F.posexplode(F.split("text", "\n")).alias("no", "raw"))
        .select("doc_id", "body", "no", s.alias("s")).filter(counts)
        .withColumn("line", F.xxhash64("s"))
    )


def _shifts(edits: int) -> list[tuple[int, int, int]]:
    """Length difference, segment and shift of every substring that a line looks up."""
    return [
        (less, i, shift) for less in range(edits + 1) for i in range(edits + 1)
        for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]


def _pieces(edits: int):
    """Function of a line's length: begin, end and seed of every substring that the line looks up."""
    shifts, parts = _shifts(edits), edits + 1

    @lru_cache(4096)
    def of(n: int) -> list[tuple[int, int, int]]:
        out = []
        for less, i, shift in shifts:
            base, longer = divmod(n - less, parts)  # the last segments are the longer ones
            start = base * i + max(0, i - (parts - longer)) + shift
            out.append((start, start + base + (i >= parts - longer), (n - less) * parts + i))
        return out

    return of


def _segments(edits: int, least: int):
    """Arrow function: texts to (key, line, own), a key being segment number, indexed length and substring.

    ``own`` marks a line's own segments, which are the index; the rest are
    probes. A line that recurs in a batch is cut up once.
    """
    own = np.array([less == 0 and shift == 0 for less, _, shift in _shifts(edits)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(edits)
        for batch in slices(batches):
            seen, keys, lines = set(), [], []
            for text in batch.column("text").to_pylist():
                for raw in (text or "").split("\n"):
                    s = raw.strip(BLANKS)
                    if len(s) < least or s in seen:
                        continue
                    seen.add(s)
                    lines.append(xxh64_intdigest(s.encode(), 42))
                    if s.isascii():
                        whole = s.encode()
                        keys += [xxh64_intdigest(whole[start:end], seed) for start, end, seed in pieces(len(s))]
                    else:
                        keys += [xxh64_intdigest(s[start:end].encode(), seed) for start, end, seed in pieces(len(s))]
            signed = lambda x: np.array(x, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(keys)), pa.array(np.repeat(signed(lines), len(own))), pa.array(np.tile(own, len(lines)))],
                names=["key", "line", "own"])

    return run


def banded_distance(a: list[str], b: list[str], k: int) -> np.ndarray:
    """Edit distances of pairs, exact up to ``k`` and larger than ``k`` beyond.

    Bit t of a pair's words is row j - k + t of column j; the band moves down a
    row per column, so 2k + 1 bits hold it, and all pairs advance together.
    """
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    wide = max(m.max(initial=0), n.max(initial=0))
    left = np.zeros((len(a), wide + 3 * k + 2), np.uint32)  # row i at column i + k, 0 outside the text
    right = np.zeros((len(a), wide + 1), np.uint32)
    for r, (x, y) in enumerate(zip(a, b)):
        left[r, k + 1:k + 1 + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
        right[r, 1:1 + len(y)] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    width = 2 * k + 1
    mask, one = np.uint64((1 << width) - 1), np.uint64(1)
    vp = np.full(len(a), ((1 << (k + 1)) - 1) << k, np.uint64)
    vn = np.zeros(len(a), np.uint64)
    score = np.full(len(a), k, np.int64)
    for j in range(1, int(n.max(initial=0)) + 1):
        x = np.zeros(len(a), np.uint64)
        for t in range(width):
            x |= (left[:, j + t] == right[:, j]).astype(np.uint64) << np.uint64(t)
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        diagonal = (one - (d0 >> np.uint64(2 * k) & one)).astype(np.int64)
        row = np.clip(m - j + k, 0, 2 * k).astype(np.uint64)
        across = (hp >> row & one).astype(np.int64) - (hn >> row & one).astype(np.int64)
        score += np.where(j > n, 0, np.where(j <= m - k, diagonal, across))
        down = d0 >> one
        vp = (hn | ~(down | hp)) & mask
        vn = down & hp
    return np.where(np.abs(m - n) > k, k + 1, score)


def _trimmed(a: str, b: str, margin: int = 32) -> tuple[str, str]:
    """Two texts without what they begin and end with alike, which edits need not touch; but for a margin."""
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    n = min(len(x), len(y))
    apart = np.flatnonzero(x[:n] != y[:n])
    start = int(apart[0]) if len(apart) else n
    apart = np.flatnonzero(x[len(x) - n + start:][::-1] != y[len(y) - n + start:][::-1])
    end = int(apart[0]) if len(apart) else n - start
    start, end = max(0, start - margin), max(0, end - margin)
    return a[start:len(a) - end], b[start:len(b) - end]


def _verify(k: int):
    """Arrow function: pairs with their texts to the pairs that are near.

    Pairs of about the same length are compared side by side, as many as keep
    within ``CHARS``; long ones are trimmed first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "sa", "sb")))
            rows = [(a, b, *(_trimmed(x, y) if len(x) > 256 else (x, y))) for a, b, x, y in rows]
            rows.sort(key=lambda r: max(len(r[2]), len(r[3])))
            near, at = [], 0
            while at < len(rows):
                end = at + 1
                while end < len(rows) and end - at < PAIRS and (end - at + 1) * max(len(rows[end][2]), len(rows[end][3])) <= CHARS:
                    end += 1
                some, at = rows[at:end], end
                far = banded_distance([r[2] for r in some], [r[3] for r in some], k)
                near += [r[:2] for r, d in zip(some, far) if d <= k]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in near], pa.int64()), pa.array([r[1] for r in near], pa.int64())], names=["a", "b"])

    return run


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """line, s, n, sig: bit h of ``sig`` is the parity of the character pairs that hash to h."""
    for batch in batches:
        sizes, sigs = [], []
        for s in batch.column("s").to_pylist():
            c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            bits = mixed((c[:-1] << np.uint64(32)) | c[1:]) >> np.uint64(58)
            odd = (np.bincount(bits.astype(np.int64), minlength=64) & 1).astype(np.uint64)
            sizes.append(len(c))
            sigs.append(int((odd << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("line"), batch.column("s"), pa.array(sizes, pa.int32()), pa.array(sigs, pa.int64())],
            names=["line", "s", "n", "sig"])


def _near(edits: int, na: str, sa: str, nb: str, sb: str) -> Column:
    """What lines within the edits must satisfy by length and sketch."""
    return (F.abs(F.col(na) - F.col(nb)) <= edits) & (F.bit_count(F.col(sa).bitwiseXOR(F.col(sb))) <= 4 * edits)


def _links(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) of lines that are near."""
    side = lambda x: texts.select(F.col("line").alias(x), *[F.col(c).alias(c + x) for c in ("s", "n", "sig")])
    return (
        pairs.join(side("a"), "a").join(side("b"), "b").filter(_near(edits, "na", "siga", "nb", "sigb"))
        .select("a", "b", "sa", "sb").mapInArrow(_verify(edits), "a long, b long")
    )


def line_classes(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """node, component: lines (hashes) that are near another one, with the smallest hash they reach."""
    lines = _lines(docs, least)
    scratch = Scratch()
    entries = docs.select("text").mapInArrow(
        _segments(edits, least), "key long, line long, own boolean")
    keys = (
        entries.groupBy("key").agg(
            F.min("line").alias("low"), F.max("line").alias("high"), F.min(F.when(F.col("own"), F.col("line"))).alias("lead"))
        .filter((F.col("low") != F.col("high")) & F.col("lead").isNotNull()).select("key", "lead")
    )
    shared = scratch.write(entries.join(keys, "key").distinct(), "segments")
    ids = scratch.write(shared.select("line").distinct(), "lines")
    texts = scratch.write(
        lines.select("line", "s").join(few(ids), "line", "left_semi").dropDuplicates(["line"])
        .mapInArrow(_sketch, "line long, s string, n int, sig long"), "texts")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = scratch.write(shared.filter(F.col("line") != F.col("lead")).select(*pair("line", "lead")).distinct(), "first")
    links = scratch.write(_links(first, texts, edits).distinct(), "links")
    found = components(links)

    labelled = scratch.write(
        shared.select("key", "line", "own").join(texts.select("line", "n", "sig"), "line").join(
            found.withColumnRenamed("node", "line"), "line", "left")
        .withColumn("component", F.coalesce("component", "line")), "labelled")
    split = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    labelled = labelled.join(split.select("key"), "key", "left_semi")
    index = labelled.filter("own")
    parts = index.groupBy("key").agg((F.floor(F.count("*") / BLOCK_ROWS) + 1).cast("int").alias("parts"))
    named = lambda df, mark: df.select("key", "part", *[F.col(c).alias(c + mark) for c in ("line", "n", "sig", "component")])
    left = named(index.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int")), "_i")
    right = named(labelled.join(parts, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "_p")
    second = left.join(right, ["key", "part"]).filter(
        (F.col("component_i") != F.col("component_p")) & _near(edits, "n_i", "sig_i", "n_p", "sig_p")
    ).select(*pair("line_i", "line_p")).distinct().join(first, ["a", "b"], "left_anti")
    found = components(links.unionByName(_links(scratch.write(second, "second"), texts, edits)))
    scratch.free()
    return found


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, every_row: bool = False) -> DataFrame:
    """``docs`` with every repeated line dropped but its first, and ``n_lines`` and ``n_dropped``.

    Lines are taken without blanks at their ends. From ``least`` code points on
    they repeat each other within ``edits`` edits, shorter ones if they are
    equal; of a class of lines the one of the smallest (doc_id, line number)
    stays. Rows without a doc_id are not touched and claim no line; with
    ``every_row`` they take part, after all others. Blank lines and shorter ones
    that are a bare ``WORD`` stay. One row in, one row out, all columns pass through;
    columns already called ``n_lines`` or ``n_dropped`` are replaced. A null text
    stays null with 0 lines, an empty one is one line. Several texts under one id
    are documents of their own. Rows that repeat both id and text are the same
    document, so each keeps its first lines.
    """
    scratch = Scratch()
    part = docs if every_row else docs.filter(F.col("doc_id").isNotNull())
    named = few(scratch.write(line_classes(part, edits, least).withColumnRenamed("node", "line"), "classes"))
    places = (
        _lines(part, least, short=True).select("doc_id", "body", "no", "line").join(named, "line", "left")
        .select("doc_id", "body", "no", F.coalesce("component", "line").alias("line"))
    )
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "no", "body")
    firsts = few(scratch.write(
        places.groupBy("line").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first <> last").drop("last"),
        "firsts"))
    drops = scratch.write(
        places.join(firsts, "line").filter(~at.eqNullSafe(F.col("first")))
        .groupBy("doc_id", "body").agg(F.collect_set("no").alias("drops")), "drops")
    some, lines = drops.agg(F.count("*"), F.coalesce(F.sum(F.size("drops")), F.lit(0))).first()
    scratch.free(drops)
    small = some <= BROADCAST_ROWS and lines <= BROADCAST_DROPS
    docs = docs.drop("n_lines", "n_dropped")
    of, in_, gone, body = unused(docs, "of_", "in_", "drops", "body_")
    drops = drops.select(F.col("doc_id").alias(of), F.col("body").alias(in_), F.col("drops").alias(gone))
    joined = docs.withColumn(body, F.xxhash64("text")).join(
        F.broadcast(drops) if small else drops, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(body) == F.col(in_)), "left")
    kept = let(F.split("text", "\n"), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: lines[i]), "\n"))
    return (
        joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))
        .withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept))
        .withColumn("n_dropped", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
        .drop(of, in_, gone, body)
    )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left, one row per document row."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")
