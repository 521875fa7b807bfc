"""Source divergence, exact inner-product search and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cabinlift.llm import bitsliced, divergence, periodic
from tests.llm.support import documents

VECTORS = "vec_id long, embedding array<float>, label int, v string, dim string, mark string, block int, score string"


# Source divergence

def letters(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)


def plain_divergence(rows):
    """rows of (text, lang, source)"""
    rows = [tuple(x or "" for x in row) for row in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        counts[lang, source].update(letters(text))
        docs[lang].update(set(letters(text)))
    share = lambda n, total, v: 1 + 10**9 * (n + 2) // (total + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= 10]
        groups = {s: counts[lang, s] for x, s in counts if x == lang}
        whole = Counter()
        for c in groups.values():
            whole.update({t: c[t] for t in kept})
        p = lambda c, t: share(c[t], sum(c[u] for u in kept), len(kept))
        shares = {s: {t: p(c, t) for t in kept} for s, c in groups.items()}
        general = {t: p(whole, t) for t in kept}
        for s, own in shares.items():
            pairs = [(sum(f(own[t], other[t]) for t in kept), o) for o, other in shares.items() if o != s]
            terms = [(f(own[t], general[t]), t) for t in kept if groups[s][t] and own[t] > general[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:10 if part == "term" else None], 1)}
    return out


def divergence_of(spark, rows):
    schema = "text string, lang string, source string, term string, n long, p long, kept string, part string, total string"
    docs = spark.createDataFrame([(*row, "a", 1, 2, "b", "c", "d") for row in rows], schema).repartition(3)
    found = [tuple(r) for r in divergence.divergence_report(docs).collect()]
    assert len(found) == len(set(found))
    return set(found)


def corpus(rng, n=160, sources=6):
    rows = []
    for i in range(n):
        source = rng.choice([f"s{k}" for k in range(sources)] + ["hot"] * 4 + [None])
        own = [f"{source}-only" * 2] * rng.randint(0, 3)
        words = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))]
        rows.append((" ".join(words + own + ["Éa", "éa", "Zz,zZ"] * rng.randint(0, 1)), rng.choice(["en", "de", None]), source))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_equals_plain(spark, seed, monkeypatch):
    if seed == 2:  # many tiles, merges and hand-ons
        for name, value in (("BLOCK", 2), ("BUCKET", 4), ("FAN_IN", 2), ("GATHERED", 5), ("HELD", 3), ("PIECE", 8)):
            monkeypatch.setattr(divergence, name, value)
    rows = corpus(random.Random(seed))
    assert divergence_of(spark, rows) == plain_divergence(rows)


def test_divergence_odd_rows(spark):
    rows = [(None, None, None), ("", "", ""), ("lone words here", "xx", "a"), (None, "xx", "b"), ("12 34 --", "xx", None)]
    rows += [("same text " * 3, "fr", "a")] * 12 + [("ß" * 50_000 + " same", "fr", "b")]
    got = divergence_of(spark, rows)
    assert got == plain_divergence(rows)
    assert {r[4] for r in got if r[0] == "xx"} == {0}  # nothing kept, all distances 0


def test_divergence_empty(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.divergence_report(empty).collect() == []


def test_skyband_equals_counting():
    rng = np.random.default_rng(3)
    for n, high, k in ((0, 5, 3), (300, 6, 1), (2000, 50, 10), (1500, 2000, 4)):
        a, b = rng.integers(1, high, n), rng.integers(1, high, n)
        want = [np.count_nonzero((a[:i] >= a[i]) & (b[:i] <= b[i])) < k for i in range(n)]
        assert divergence.skyband(a, b, k, 64).tolist() == want
    # The band of a union is in the union of the bands.
    a, b = rng.integers(1, 40, 900), rng.integers(1, 40, 900)
    whole = np.flatnonzero(divergence.skyband(a, b, 5))
    halves = [np.arange(x, 900, 2) for x in (0, 1)]
    parts = np.sort(np.concatenate([h[divergence.skyband(a[h], b[h], 5)] for h in halves]))
    assert parts[divergence.skyband(a[parts], b[parts], 5)].tolist() == whole.tolist()


def test_large_shares_stay_exact(spark):
    n = 9_000_000_000_000_000
    got = spark.range(1).select(divergence._share(*(divergence.F.lit(x) for x in (n, n + 7, 11)))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (n + 7 + 22)


# Exact inner products

def plain_products(rows, k=5):
    fit = sorted({(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows if i is not None and v is not None
                  and all(x is not None and np.isfinite(x) for x in v)})
    whole = [(i, tuple(int(np.floor(x * 256)) for x in v)) for i, v in fit]
    out = []
    for i, q in whole:
        if i % 50 == 0:
            hits = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out)


def products_of(spark, rows):
    df = spark.createDataFrame([(i, v, 0, "a", "b", "c", 1, "d") for i, v in rows], VECTORS).repartition(3)
    return sorted(tuple(r) for r in bitsliced.product_report(df).collect())


@pytest.mark.parametrize("kind", ["normal", "coarse", "wide", "skewed"])
def test_products_equal_plain(spark, kind):
    rng = np.random.default_rng(5)
    n = 2600 if kind == "normal" else 700
    x = {"normal": lambda: rng.normal(size=(n, 12)) / 3, "coarse": lambda: rng.integers(-2, 3, (n, 3)) / 256,
         "wide": lambda: rng.normal(size=(n, 6)) * 10.0 ** rng.integers(-3, 5, (n, 1)),
         "skewed": lambda: np.abs(rng.normal(size=(n, 8))) + [0, 0, 0, 0, 0, 0, 900, -900]}[kind]()
    rows = list(enumerate(x.astype(np.float32).tolist()))
    assert products_of(spark, rows) == plain_products(rows)


def test_products_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (0, [1.0, -0.5]), (50, [0.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]),
            (5, [1.0]), (None, [1.0, 1.0]), (6, []), (100, []), (7, [-0.0, 0.001]), (8, [2.0, 2.0]), (8, [2.0, 2.0]), (9, [2.0, 2.0]),
            (150, [3.0]), (-50, [0.25, 0.25])]
    assert products_of(spark, rows) == plain_products(rows)
    twice = [(0, [1.0]), (0, [2.0]), (1, [3.0]), (2, [-1.0])]  # two vectors under one id are two queries
    assert products_of(spark, twice) == plain_products(twice)
    assert products_of(spark, []) == [] and products_of(spark, [(0, [1.0])]) == []


def test_products_beyond_64_bits(spark):
    rows = [(0, [3e38, 1.0]), (1, [2e38, 0.0]), (2, [-3e38, 0.0]), (3, [1e9, 5.0])]
    got = products_of(spark, rows)
    assert [(r[2], r[3]) for r in got][::2] == [(1, 2**63 - 1), (2, -2**63)]


def test_index_slices_hold_the_sums():
    rng = np.random.default_rng(7)
    x, q = rng.integers(-200, 300, (130, 9)), rng.integers(-40, 40, 9)
    index = bitsliced.BitSlicedIndex(x, slices=20)  # no slice is left out
    bits = np.array([np.unpackbits(s.view(np.uint8), count=130, bitorder="little") for s in index.sums(q)]).astype(np.int64)
    sums = (bits << np.arange(len(bits))[:, None]).sum(axis=0)
    assert len(set((x @ q - sums).tolist())) == 1
    for slices in (1, 3, 6):
        index = bitsliced.BitSlicedIndex(x, slices)
        want = sorted(zip((-(x @ q)).tolist(), range(130)))[:7]
        assert [(-s, i) for i, s in index.best(q, np.arange(130), 7)] == want


# Periodic runs

def plain_runs(words, least=12):
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, 2 * p):
                out.setdefault((s, i + p), p)
            i += i == s
    return sorted((s, e - s, p) for (s, e), p in out.items())


def fibonacci(n):
    a, b = ["x"], ["x", "y"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def texts(seed):
    rng = random.Random(seed)
    out = [None, "", " \t\n", "one", "a " * 12, "a " * 11, "A a " * 6, "  x y " * 8, "\x1c\x1d " * 20, "ab\x0bcd\x0c" * 7]
    out += [" ".join(fibonacci(150)), "w" * 100_000 + " w" * 13, " ".join(["q"] * 3000)]
    for _ in range(60):
        n, k = rng.randint(1, 120), rng.choice([2, 3, 5, 40])
        words = [f"w{rng.randrange(k)}" for _ in range(n)]
        if rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)] + words[:rng.randint(0, 9)]
        out.append(rng.choice([" ", "\n", "\t "]).join(words))
    return out + out[-3:]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("chunk", [None, 16])
def test_runs_equal_plain(spark, chunk, monkeypatch):
    if chunk:
        monkeypatch.setattr(periodic, "CHUNK", chunk)
        monkeypatch.setattr(periodic, "LONGEST", 2)
    given = texts(11)
    got = periodic.periodic_runs(documents(spark, given)).collect()
    assert len(got) == len(given)
    for row in got:
        words = split(given[row["doc_id"]])
        want = plain_runs(words)
        assert row["n_words"] == len(words)
        assert [tuple(r) for r in row["runs"]] == want
        assert row["collapsed"] == collapsed(words, want)


def test_report_equals_plain(spark):
    given = texts(12) * 3
    ids = [*range(1, len(given))] + [None]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in zip(ids, given):
        words = split(text)
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        runs = plain_runs(words)
        s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        want.append((i, len(runs), s, n, p, 1000 * n // p if runs else None,
                     sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(collapsed(words, runs))))
    got = [tuple(r) for r in periodic.run_report(documents(spark, given, ids)).collect()]
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order(want)


def test_runs_of_no_documents(spark):
    assert periodic.run_report(documents(spark, ["x"]).limit(0)).collect() == []


def test_grammar_spells_the_words():
    rng = np.random.default_rng(9)
    words = np.concatenate([rng.integers(0, 4, 400), np.tile(rng.integers(4, 30, 37), 20), np.full(100, 31)])
    starts, (rule, low, mid, high) = periodic.repair(words.copy())
    spelled = {}
    for r, a, m, b in zip(rule.tolist(), low, mid, high):
        assert a < m < b
        assert spelled.setdefault(r, (m - a, words[a:b].tolist())) == (m - a, words[a:b].tolist())
    # What is left has no pair of neighbours twice, but where a symbol overlaps itself.
    left = [tuple(words[a:b].tolist()) for a, b in zip(starts, starts[1:])]
    pairs = Counter(zip(left, left[1:]))
    assert all(n == 1 for (a, b), n in pairs.items() if a != b)
