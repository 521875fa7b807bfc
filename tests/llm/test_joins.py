"""Joins and searches against brute force over small tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cabinlift.llm import ann, decontaminate, line_dedup, ngram_join
from cabinlift.llm.components import components
from tests.llm.support import Groups, documents, plain, spaced


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, most, letters):
    out = list(text)
    for _ in range(rng.randint(0, most)):
        at = rng.randint(0, len(out))
        kind = rng.randint(0, 2)
        if kind == 0:
            out.insert(at, rng.choice(letters))
        elif at < len(out):
            out[at:at + 1] = [] if kind == 1 else [rng.choice(letters)]
    return "".join(out)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(7, 200 + i) for i in range(40)]
    groups = Groups({x for e in edges for x in e})
    for e in edges:
        groups.join(*e)
    got = {tuple(r) for r in components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {(x, groups.find(x)) for x in linked}


def test_banded_distance():
    rng = random.Random(3)
    for k in (1, 2, 3):
        a = ["".join(rng.choice("abé\U0001d11e") for _ in range(rng.randint(3 * k, 25))) for _ in range(300)]
        b = [edited(rng, x, k + 2, "abc") for x in a]
        for x, y, d in zip(a, b, line_dedup.banded_distance(a, b, k)):
            true = distance(x, y)
            assert d == true if true <= k else d > k


def test_line_dedup(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(60)).strip().ljust(50, "x") for _ in range(6)]
    texts = ["\n".join([*(edited(rng, rng.choice(base), 4, "yz").strip() for _ in range(3)), "short"]) for _ in range(50)]
    ids = [*range(50), 60, 61, None, 3]
    docs = documents(spark, [*texts, None, "", texts[0], texts[3]], ids)
    places = sorted((i, no, line) for i, t in zip(range(50), texts) for no, line in enumerate(t.split("\n")) if len(line) >= 40)
    groups = Groups(range(len(places)))
    for i, (_, _, a) in enumerate(places):
        for j in range(i):
            if abs(len(a) - len(places[j][2])) <= 2 and distance(a, places[j][2]) <= 2:
                groups.join(i, j)
    kept = {places[i][:2] for i in range(len(places)) if groups.find(i) == i}
    want = {i: "\n".join(line for no, line in enumerate(t.split("\n")) if len(line) < 40 or (i, no) in kept)
            for i, t in zip(range(50), texts)} | {60: None, 61: ""}
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = got.collect()
    assert len(rows) == 54
    for r in rows:
        assert r["text"] == (texts[0] if r["doc_id"] is None else want[r["doc_id"]])
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_short_lines_go_when_they_are_equal(spark):
    long = "A line that is long enough to be compared by edits."
    texts = [f"All rights reserved.\n{long}\nword\n\n好的 \nÉouch.", f"  All rights reserved.\t\nAll rights reserve.\nword\n\n好的\n{long}!",
             "All rights reserved.\nÉouch.\n42", "All rights reserved.\nAll rights reserved.\n42\n}\n}"]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.line_report(documents(spark, texts)).collect()}
    assert got == {0: (texts[0], 0), 1: ("All rights reserve.\nword\n", 3), 2: ("42", 2), 3: ("42\n}", 3)}


def test_line_dedup_with_clashing_names_and_shared_ids(spark):
    line = "this line is long enough to be taken for a repeated one"
    rows = [(1, f"{line}\none", "a"), (1, f"{line}\ntwo", "b"), (2, f"x\n{line}", "c"), (None, f"{line}\nnone", "d"), (None, line, "e")]
    names = ("drops", "of_", "in_", "body_", "DROPS_", "n_lines", "line", "no")
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").select(
        "*", *[F.lit(n).alias(n) for n in names])
    got = line_dedup.dedup_lines(docs, every_row=True).collect()
    assert all(r[n] == n for r in got for n in names if n != "n_lines")
    texts = sorted(r["text"] for r in got)
    # Of the two texts with the line in the same place one keeps it; rows without an id come last.
    assert texts in (sorted([f"{line}\none", "two", "x", "none", ""]), sorted(["one", f"{line}\ntwo", "x", "none", ""]))


def test_very_long_lines_are_compared(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000)).strip()
    texts = [long, long[:150_000] + "#" + long[150_001:], long[1:] + "#", long[:1000] + "###" + long[1003:], long[::-1]]
    got = line_dedup.dedup_lines(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r["n_dropped"] for r in got] == [0, 1, 1, 0, 0]
    for a, b in ((long, texts[2]), (long, texts[3]), (long[:300], long[:300] + "x")):
        x, y = line_dedup._trimmed(a, b)
        assert min(len(x), len(y)) >= 30 and distance(x[:200], y[:200]) <= 3


def test_every_line_within_the_edits_shares_a_key():
    rng = random.Random(8)
    import pyarrow as pa

    for _ in range(200):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(40, 60)))
        b = edited(rng, a, 2, "abc")
        if len(b) < 40 or a == b or a.strip() != a or b.strip() != b:
            continue
        out = next(line_dedup._segments(2, 40)(iter([pa.RecordBatch.from_pydict({"text": [a, b]})]))).to_pylist()
        own = {(r["key"], r["line"]) for r in out if r["own"]}
        assert any((r["key"], other) in own for r in out for other in {x["line"] for x in out} - {r["line"]})


@pytest.mark.parametrize("blocks", [2_000, 3])
def test_ngram_join(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", blocks)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    common = [rng.choice(vocabulary) for _ in range(25)]
    texts = []
    for _ in range(12):
        seed = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 9)):
            one = list(seed)
            for _ in range(rng.randint(0, 5)):
                one[rng.randrange(len(one))] = rng.choice(vocabulary)
            texts.append(" ".join(one + (common if rng.random() < 0.3 else [])))
    texts += [None, "", " \t\n", "one", "ONE", "one two", "One\ntwo", "a b c d", "w " * 3000, "w " * 2000, *texts[:6]]
    ids = [*range(1000, 1000 + len(texts) - 1), None]
    sets = {}
    for i, t in zip(ids, texts):
        w = spaced(t)
        sets[i] = frozenset(tuple(w[j:j + 4]) for j in range(max(1, len(w) - 3))) if w else frozenset()
    known = [i for i in ids if i is not None]
    groups = Groups(known)
    for a in known:
        for b in known:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                groups.join(a, b)
    docs = documents(spark, texts, ids)
    rows = ngram_join.jaccard_components(docs.union(docs.filter("doc_id = 1003"))).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        i = r["doc_id"]
        assert r["n_shingles"] == len(sets[i])
        assert r["component_id"] == (None if i is None else groups.find(i))
    if blocks == 3:
        assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_contamination(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["été"]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randint(13, 40)))) for i in range(20)] + [
        (20, "w1 w2"), (21, "W3, w4 w5 w6 w7 w8 w9 w10 w11 w12"), (22, ""), (23, None), (None, " ".join(prose(20))), (24, "w1 w2"), (0, "x y z")]
    texts = []
    for _ in range(40):
        words = prose(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            source = plain(rng.choice(items[:20])[1])
            start = rng.randrange(len(source))
            at = rng.randint(0, len(words))
            words[at:at] = source[start:start + rng.randint(5, 30)]
        texts.append(", ".join(words).upper() if rng.random() < 0.3 else " ".join(words))
    texts += [None, "", "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12", texts[0]]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("digest", F.lit(1))
    docs = documents(spark, texts, [*range(len(texts) - 1), None])
    windows = {}
    for i, t in items:
        w = plain(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n and i is not None else 0):
            windows.setdefault(tuple(w[j:j + n]), set()).add(i)
    got = {r["doc_id"]: r for r in decontaminate.contamination_report(docs, bench).collect()}
    assert len(got) == len(texts)
    for i, t in zip([*range(len(texts) - 1), None], texts):
        w, hit, ids = plain(t), set(), set()
        for window, of in windows.items():
            for j in range(len(w) - len(window) + 1):
                if tuple(w[j:j + len(window)]) == window:
                    hit |= set(range(j, j + len(window)))
                    ids |= of
        joined = ",".join(sorted(map(str, ids)))
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (
            len(w), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    assert decontaminate.contamination_report(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination_report(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_neighbours_of_few_vectors_are_exact(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [0.0, 1.0]),
            (None, [1.0, 1.0]), (50, [1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (1, [2.0, 0.0]), (8, [inf, 1.0]), (100, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.neighbour_report(vectors).collect())
    s = round(0.5 ** 0.5, 9)
    assert got == [(0, 1, 1, 1.0), (0, 2, 50, s), (0, 3, 6, 0.0), (50, 1, 0, s), (50, 2, 1, s), (50, 3, 6, s)]
    assert ann.neighbour_report(vectors.limit(0)).count() == 0


def test_recall_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "DATA_BLOCK", 700)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").union(
        spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("vec_id = 11").select(
            F.explode(F.sequence(F.lit(9001).cast("long"), F.lit(9300).cast("long"))).alias("vec_id"), "embedding", "label"))
    table = ann.usable(vectors).collect()
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["v"] for r in table])
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = {}
    for r in ann.neighbour_report(vectors).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = np.round(x @ x[q], 9)
        score[ids == ids[q]] = -9
        best = set(ids[np.lexsort((ids, -score))[:5]].tolist())
        mine = sorted(found[int(ids[q])])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        hits, total = hits + len(best & {m[1] for m in mine}), total + 5
    assert hits / total >= 0.9
