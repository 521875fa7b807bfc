"""Passages that repeat themselves, found on a grammar of the words.

The words of each text are compressed by Re-Pair: repeated neighbours become a
symbol of their own until no pair of neighbours occurs twice. A stretch that
repeats lies across the middle of some symbol, or across a border between the
symbols that are left, which halve the text like a tree. So it is enough to look
across the middle of every symbol once, however often the symbol occurs, and to
carry what is found to all places the symbol stands for. Pieces of a longer run
are merged.

Rounds of Re-Pair replace many pairs at once, the most frequent (in powers of
two) first: a pair is taken if no more important one shares a word with it, and
then all its occurrences are replaced. Texts are compressed side by side in
numpy, with symbols of their own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cabinlift.llm.columns import let
from cabinlift.llm.grams import mixed, slices

# Fixed value of the data contract: words of the shortest run.
LEAST_WORDS = 12

#: Words looked at together, and the longest stretch (a power of two) that is compared in one step.
CHUNK, LONGEST = 1 << 21, 12
#: Words that are compared first; a run shows as at least LEAST_WORDS / 2 equal words on end.
GRAM = 3

RUNS = "array<struct<start:long,length:long,period:long>>"


def repair(symbols: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Re-Pair: the first word of each symbol that is left, and all replacements.

    Replacements come as rule, first word, middle and end; a rule that occurs
    in several places is listed for each. Texts on end need symbols of their own.
    """
    n = len(symbols)
    starts = np.arange(n + 1)
    fresh = int(symbols.max()) + 1 if n else 0
    first_in = np.full(fresh + n, -1, np.int64)
    second_in = np.full(fresh + n, -1, np.int64)
    live = np.ones(n, bool)
    done: list[tuple[np.ndarray, ...]] = []
    while True:
        at = np.flatnonzero(live[:-1])
        pairs, which, times = np.unique(symbols[at] << 32 | symbols[at + 1], return_inverse=True, return_counts=True)
        often = times > 1
        live[at[~often[which]]] = False
        if not often.any():
            break
        at, which = at[often[which]], (np.cumsum(often) - 1)[which[often[which]]]
        pairs, times = pairs[often], times[often]
        left, right = pairs >> 32, pairs & 0xFFFFFFFF
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((mixed(pairs.astype(np.uint64)), np.frexp(times)[1]))] = np.arange(len(pairs))
        np.maximum.at(first_in, left, rank)
        np.maximum.at(second_in, right, rank)
        taken = (rank >= first_in[right]) & (rank >= second_in[left])
        first_in[left] = -1
        second_in[right] = -1
        at, which = at[taken[which]], which[taken[which]]
        # Of a symbol that follows itself, every other pair is taken.
        new = np.ones(len(at), bool)
        new[1:] = np.diff(at) != 1
        single = (at - np.maximum.accumulate(np.where(new, at, 0))) % 2 == 0
        at, which = at[single], which[single]
        rule = fresh + (np.cumsum(taken) - 1)[which]
        fresh += int(taken.sum())
        done.append((rule, starts[at], starts[at + 1], starts[at + 2]))
        symbols[at] = rule
        live[at] = True
        live[at[at > 0] - 1] = True
        stay = np.ones(len(symbols) + 1, bool)
        stay[at + 1] = False
        symbols, live, starts = symbols[stay[:-1]], live[stay[:-1]], starts[stay]
    empty = (np.zeros(0, np.int64),) * 4
    return starts, tuple(np.concatenate(x) for x in zip(*done)) if done else empty


def _halves(starts: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """First word, middle and end of the nodes of a binary tree over the symbols of each text, level by level."""
    firsts = np.searchsorted(starts, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(firsts))
    local, last = np.arange(len(text)) - firsts[text], firsts[1:][text]
    step = 1
    while step < int(np.diff(firsts).max(initial=0)):
        mid = np.flatnonzero((local & (2 * step - 1)) == step)
        yield starts[mid - step], starts[mid], starts[np.minimum(mid + step, last[mid])]
        step *= 2


def _chunks(*nodes: np.ndarray) -> Iterator[slice]:
    """Slices of nodes (first, middle, end) with a bounded number of words, one node at least."""
    group = np.cumsum(nodes[2] - nodes[0]) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield slice(int(a), int(b))


def _suspects(grams: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Node, period and side of what may repeat across the middle of a node, as rows.

    The equal words of such a run reach over the middle, on one of two sides;
    among them is a gram that ends or begins at the middle.
    """
    size = high - low - (GRAM - 1)
    node = np.repeat(np.arange(len(low)), size)
    at = np.arange(len(node)) - np.repeat(np.cumsum(size) - size - low, size)
    here = grams[at]
    found = []
    for side, offset in ((0, -1), (0, -GRAM), (1, 0), (1, 1 - GRAM)):
        anchor = mid + offset
        fits = (anchor >= low) & (anchor + GRAM <= high)
        value = np.where(fits, grams[np.where(fits, anchor, 0)], -1)
        hit = np.flatnonzero(here == value[node])
        period = (at[hit] - anchor[node[hit]]) * (1 - 2 * side)
        hit, period = hit[period > 0], period[period > 0]
        short = 2 * period <= (high - low)[node[hit]]
        # One number a row, so that rows that two grams give are told quickly.
        found.append(node[hit][short] << 33 | period[short] << 1 | side)
    found = np.unique(np.concatenate(found))
    return np.stack([found >> 33, found >> 1 & 0xFFFFFFFF, found & 1], axis=1)


class _Names:
    """Equal stretches of 1, 2, 4, ... words have equal names, so that stretches are compared in steps."""

    def __init__(self, words: np.ndarray, longest: int) -> None:
        self.levels = [words]
        while len(self.levels) <= LONGEST and 1 << len(self.levels) <= min(longest, len(words)):
            half, now = 1 << (len(self.levels) - 1), self.levels[-1]
            pairs = now[:-half].astype(np.int64) << 32 | now[half:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def _steps(self, room: Callable, same: Callable, n: int) -> np.ndarray:
        length = np.zeros(n, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            while True:
                ok = np.flatnonzero(room(length) >= 1 << k)
                ok = ok[same(self.levels[k], length, ok, 1 << k)]
                length[ok] += 1 << k
                if k < len(self.levels) - 1 or not len(ok):
                    break
        return length

    def forward(self, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many words from i and from j > i on are equal before ``end``."""
        return self._steps(lambda done: end - j - done,
                           lambda names, done, ok, _: names[(i + done)[ok]] == names[(j + done)[ok]], len(i))

    def backward(self, i: np.ndarray, j: np.ndarray, low: np.ndarray) -> np.ndarray:
        """How many words before i and before j > i are equal, from ``low`` on."""
        return self._steps(lambda done: i - done - low,
                           lambda names, done, ok, by: names[(i - done)[ok] - by] == names[(j - done)[ok] - by], len(i))


def _grams(words: np.ndarray) -> np.ndarray:
    """A number per GRAM = 3 words on end, equal for equal ones."""
    if int(words.max(initial=0)) < 1 << 21:
        return words[:-2] | words[1:-1] << 21 | words[2:] << 42
    pairs = np.unique(words[:-1] << 32 | words[1:], return_inverse=True)[1]
    return pairs[:-1] << 32 | words[2:]


def _across(words: np.ndarray, bounds: np.ndarray, nodes: list[tuple[np.ndarray, ...]], least: int) -> np.ndarray:
    """Node, start, end, period of the maximal runs across the middle of each node, within the node."""
    grams = _grams(words)
    low, mid, high = (np.concatenate(x) for x in zip(*nodes))
    long = np.flatnonzero(high - low >= least)
    nodes_ = low[long], mid[long], high[long]
    suspects = []
    for part in _chunks(*nodes_):
        rows = _suspects(grams, *(x[part] for x in nodes_))
        if len(rows):
            rows[:, 0] = long[rows[:, 0] + part.start]
            suspects.append(rows)
    if not suspects:
        return np.zeros((0, 4), np.int64)
    # Only texts with suspects get names.
    node, period, side = np.concatenate(suspects).T
    text = np.searchsorted(bounds, low, "right") - 1
    in_use = np.unique(text[node])
    lengths = np.diff(bounds)[in_use]
    shift = np.zeros(len(bounds), np.int64)
    shift[in_use] = bounds[in_use] - (np.cumsum(lengths) - lengths)
    some = np.repeat(shift[in_use], lengths) + np.arange(int(lengths.sum()))
    names = _Names(words[some].astype(np.int32), int(lengths.max()))
    found = []
    for a in range(0, len(node), CHUNK):
        k, p = node[a:a + CHUNK], period[a:a + CHUNK]
        back = shift[text[k]]
        i = mid[k] - back - p * side[a:a + CHUNK]
        start = i - names.backward(i, i + p, low[k] - back) + back
        end = i + p + names.forward(i, i + p, high[k] - back) + back
        fine = (start < mid[k]) & (end > mid[k]) & (end - start >= np.maximum(least, 2 * p))
        rows = np.stack([k, start, end, p], axis=1)[fine]
        rows = rows[np.lexsort(rows.T[::-1])]
        # The same stretch has several periods; the smallest counts.
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        found.append(rows[new])
    rows = np.concatenate(found)
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    return rows[new]


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one period that overlap by it or more, merged; by start, then period."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    if not len(start):
        return start, end, period
    apart = np.cumsum(np.diff(period, prepend=period[0]) != 0) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + apart)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] + apart[1:] > reach[:-1] - period[1:]
    firsts = np.flatnonzero(new)
    start, end, period = start[firsts], np.maximum.reduceat(end, firsts), period[firsts]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of texts on end, by start, then period.

    ``words`` are numbers from 0, none of which two texts share.
    """
    starts, (rule, low, mid, high) = repair(words.astype(np.int64))
    by_rule = np.argsort(rule, kind="stable")
    rule, low, mid, high = (x[by_rule] for x in (rule, low, mid, high))
    rules, once = np.unique(rule, return_index=True)
    nodes = [(low[once], mid[once], high[once]), *_halves(starts, bounds)]
    node, start, end, period = _across(words, bounds, nodes, least).T
    # What lies in a symbol is carried to every place of the symbol; a border stands for itself.
    in_rule = node < len(rules)
    own = node[in_rule]
    places = np.diff(np.append(once, len(rule)))[own]
    place = np.repeat(once[own] - np.cumsum(places) + places, places) + np.arange(int(places.sum()))
    moved = low[place] - np.repeat(low[once[own]], places)
    carried = [np.concatenate((np.repeat(x[in_rule], places) + by, x[~in_rule]))
               for x, by in ((start, moved), (end, moved), (period, 0))]
    return _merged(*carried)


def _report(least: int):
    """Arrow function: the id, number of words, runs and collapsed text of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            ids, sizes, base = [], [], 0
            for text in texts:
                words = (text.as_py() or "").encode().split()
                number = defaultdict(count(base).__next__)
                ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                sizes.append(len(words))
                base += len(number)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            start, end, period = find_runs(np.concatenate(ids), bounds, least)
            gone = np.zeros(int(bounds[-1]) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, end, -1)
            kept = np.cumsum(gone)[:-1] <= 0
            first = np.searchsorted(start, bounds)
            collapsed = []
            for text, a, b in zip(texts, bounds, bounds[1:]):
                words = (text.as_py() or "").encode().split()
                stay = kept[a:b]
                collapsed.append(b" ".join(words if stay.all() else compress(words, stay)))
            parts = [start - np.repeat(bounds[:-1], np.diff(first)), end - start, period]
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], ["start", "length", "period"])
            yield pa.record_batch([
                batch.column("doc_id"), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(first, pa.int32()), runs),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and collapsed, the text without its repetitions.

    ``docs`` needs doc_id (a whole number) and text; other columns are not read,
    whatever their names. Words are what white space separates, A-Z and a-z
    differ. A run is a stretch of at least ``least`` words and two periods in
    which words a period apart are equal, as long as possible, with its smallest
    period; runs are listed by start, then period. ``collapsed`` leaves out
    every word that some run holds after its first period, and joins the others
    by one space. Null counts as empty: no words, no runs, ''. Every row is
    reported, so repeated rows are repeated; an empty table gives none.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(_report(least), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, with a periodic end if the contract plants one: for a tenth of the ids."""
    drawn = F.crc32(doc_id.cast("long").cast("string"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def periodic(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(drawn / 10)
        at = g % n
        period = 1 + F.floor((n - at) / (3 + g % 8))
        place = lambda i: F.when(i < at, i).otherwise(at + (i - at) % period).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i))), " ")).otherwise("")

    return F.when((drawn % 10 == 0) & text.isNotNull(), let(words, periodic)).otherwise(text)


def run_report(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``periodic_runs``: number, longest run, hashes of the runs and of the collapsed text."""
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div (-best.period)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


ORACLE = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i::BIGINT)) AS t),
d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM documents, tab),
drawn AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM d),
whole AS (
  SELECT row, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
    w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) ELSE w END AS w FROM drawn),
long AS (SELECT row, unnest(range(len(w))) AS i, unnest(w) AS word FROM whole),
grams AS (SELECT row, unnest(range(greatest(len(w) - 5, 0))) AS i, w FROM whole),
named AS (SELECT row, i, array_to_string(w[i + 1:i + 6], ' ') AS gram FROM grams),
equal AS (
  SELECT x.row, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.row, y.i - x.i ORDER BY x.i) AS island
  FROM named x JOIN named y ON x.row = y.row AND x.gram = y.gram AND x.i < y.i),
stretches AS (SELECT row, q, min(i) AS start, count(*) + 5 AS equal FROM equal GROUP BY row, q, island),
runs AS (
  SELECT row, start, equal + q AS length, min(q) AS period FROM stretches
  WHERE equal >= greatest(q, 12 - q) GROUP BY ALL),
longest AS (
  SELECT row, count(*) AS n_runs, min(struct_pack(l := -length, s := start, p := period)) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
left_over AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM long ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.p AS period,
       1000 * -best.l // best.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(left_over.text, '')) AS collapsed_sha256
FROM whole LEFT JOIN longest USING (row) LEFT JOIN left_over USING (row)
"""
