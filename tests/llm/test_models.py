"""Mixing, quality and main text: properties, held-out accuracy and known pages."""

import re
from html import unescape

import numpy as np
from pyspark.sql import functions as F

from cabinlift.llm import html, mixing, quality
from tests.conftest import SMALL
from tests.llm.support import documents, spaced


def water(sizes, weights, most):
    """Targets by the contract's words: share, stop at the cap, share the excess again."""
    target, left = [0.0] * len(sizes), float(sum(sizes))
    while left > 1e-9:
        open_ = [i for i in range(len(sizes)) if target[i] < most * sizes[i] - 1e-9]
        total = sum(weights[i] for i in open_)
        if not open_:
            break
        given = 0.0
        for i in open_:
            more = min(left * weights[i] / total, most * sizes[i] - target[i])
            target[i] += more
            given += more
        left -= given
    return target


def test_mix(spark):
    rng = np.random.default_rng(2)
    sources = [["b", "a", None, "é", "B", "tiny"][i % 6] if i % 7 else "b" for i in range(900)]
    texts = ["w " * int(rng.integers(0, 60) if s != "tiny" else 1) for s in sources]
    texts[:3] = [None, "", " \n"]
    docs = documents(spark, texts, sources=sources)
    docs = docs.union(docs.filter("doc_id = 40")).union(docs.filter("doc_id = 40"))
    rows = mixing.mix(docs, block=8).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    again = mixing.mix(docs.repartition(7), block=8).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == 902
    order = sorted({s for s in sources if s is not None}) + [None]
    size, taken = dict.fromkeys(order, 0), dict.fromkeys(order, 0)
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    want = water([size[s] for s in order], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))], 3.0)
    for r in rows:
        at = order.index(r["source"])
        assert abs(r["target"] - want[at]) < 1e-6 * max(1, want[at]) and r["source_size"] == size[r["source"]]
    for s, t in zip(order, want):
        assert abs(taken[s] - t) <= 60
    by_text = {i: len(spaced(t)) for i, t in enumerate(texts)}
    assert all(r["size"] == by_text[r["doc_id"]] for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_copies_never_count_twice(spark):
    xs = [2.9999999995, 3.0, 3.0000000004, 2.99, 0.0, 0.5, 1e-10]
    whole, rest = mixing._copies(F.col("x"))
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(whole.alias("w"), rest.alias("r")).collect()
    assert [(r["w"], round(r["r"], 9)) for r in got] == [(3, 0), (3, 0), (3, 0), (2, 0.99), (0, 0), (0, 0.5), (0, 0)]


def test_repeated_labels_count_once(spark):
    docs = documents(spark, [f"word{i} " * (3 + i % 40) + ("!!! " * 9 if i % 2 else "and so on, it goes.") for i in range(300)])
    rows = [(i, i % 2) for i in range(300)]
    labels = lambda more: spark.createDataFrame(rows + more, "doc_id long, quality int")
    scores = lambda found: {r["doc_id"]: round(r["score"], 6) for r in quality.quality_report(docs, found).collect()}
    plain = scores(labels([]))
    assert scores(labels(rows[:50] * 3)) == plain and len(plain) == 300
    assert scores(labels([(i, 1 - y) for i, y in rows])) == dict.fromkeys(range(300), 0.5)  # all contradict


def test_quality_on_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality_report(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    assert right >= 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    import zlib

    every = quality.quality_report(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in every)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    same = {r["doc_id"]: r["score"] for r in quality.quality_report(docs, flipped).collect()}
    assert all(abs(same[r["doc_id"]] - r["score"]) < 1e-9 for r in every)


def test_quality_of_odd_rows(spark):
    docs = documents(spark, [None, "", "word " * 50_000, "a\x00b", "x"], [1, 2, 3, None, 1])
    none = spark.createDataFrame([], "doc_id long, quality int, x string")
    assert [r["score"] for r in quality.quality_report(docs, none).collect()] == [0.5] * 5
    few = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (3, None, "c"), (3, 1, "d"), (4, 7, "e")], "doc_id long, quality int, x string")
    rows = quality.quality_report(docs, few).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.keep_good(docs, few).columns == docs.columns
    assert quality.quality_report(docs.limit(0), few).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 1, 0.5, 0.4, 2, 1.0]), np.ones(6))
    assert list(y) == sorted(y) and abs(y[1] - 1.9 / 3) < 1e-9


def test_main_text_of_known_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", row["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip()
                 for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(p for p in parts if p)
        assert (got[row["page_id"]]["text"], got[row["page_id"]]["n_chars"]) == (want, len(want))


def test_main_text_of_odd_pages(spark):
    page = ('<body><header><h1>Site</h1></header><div class="post"><h2>T</h2><p>Hello, &amp; world. It is, a long text that goes on,'
            " for ever.<p>Second&nbsp;para is here, too.<ul><li>one<li>two</ul></div><div class='comments'><p>I agree, with that, so"
            " much.</p></div><form>name, please, here.</form><footer>c</footer>")
    want = "T\nHello, & world. It is, a long text that goes on, for ever.\nSecond para is here, too.\none\ntwo"
    assert html.main_text(page) == want
    assert [html.main_text(x) for x in (None, "", "plain a < b", "<p", "<script>x")] == ["", "", "plain a < b", "", ""]
    long = "<article>" + "<p>Some words, here.</p>" * 20_000 + "</article>"
    assert html.main_text(long).count("\n") == 19_999
    rows = [(1, None, None, "x"), (None, "u", "<p>a</p>", "y"), (1, None, None, "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in html.extract(table).collect()) == [("", 0), ("", 0), ("a", 1)]
    assert html.extract(table.limit(0)).count() == 0


def test_parts_of_an_article_stay_together():
    short, long = "A lead, of some words, that opens it.", "The longer part, with commas, goes on and on, for ever, and more. " * 4
    long = long.strip()
    nav = "<nav>Home, news, more</nav>"
    want = f"T\n{short}\n{long}\n{short}"
    for part in ("section", "blockquote", "div"):
        inner = f"<h1>T</h1><p>{short}</p><{part}><p>{long}</p></{part}><p>{short}</p>"
        for page in (f"<body>{nav}<article>{inner}</article></body>", f"<body>{nav}<main>{inner}</main><footer>c</footer></body>"):
            assert html.main_text(page) == want, page
    halves = f"<section><h2>A</h2><p>{long}</p></section><section><h2>B</h2><p>{long[:140]}</p></section>"
    for page in (f"<body>{nav}<div>{halves}</div></body>", nav + halves):
        assert html.main_text(page) == f"A\n{long}\nB\n{long[:140].strip()}", page
    quote = f"<body>{nav}<div><h1>T</h1><blockquote><p>{long}</p></blockquote><p>{short}</p></div></body>"
    assert html.main_text(quote) == f"T\n{long}\n{short}"
    table = f"<article><h1>T</h1><table><tr><td>{long}</td><td>x</td></tr></table><p>{short}</p></article>"
    assert html.main_text(table) == f"T\n{long}\nx\n{short}"


LONG = "A long sentence, with words. " * 8
ARTICLE = (f"<h1>Title</h1><p>{LONG}</p><p title='a hidden gem'>Found, at last. Yes.</p>"
           "<p class='related-work'>Others, too, wrote. Much.</p>")
WANT = f"Title\n{LONG.strip()}\nFound, at last. Yes.\nOthers, too, wrote. Much."


def test_layout_names_are_no_furniture():
    page = "<html><body><nav>Home</nav>%s<div class='site-footer'>Imprint, terms.</div><footer>bye.</footer></body></html>"
    for around in ("<div id='content' class='no-sidebar'>%s</div>", "<div class='post comments-open'>%s</div>",
                   "<div class='has-sidebar with-comments single-post'>%s</div>", "<div class='widget'>%s</div>",
                   "<div class=main>%s</div><div class='comment-list'><p>" + "I think, well, no. " * 99 + "</p></div>",
                   "<div>%s<div class='ad-slot'>Buy, now.</div></div>", "<div>%s<p hidden>No.</p><p style='display : none'>No.</p></div>",
                   "<div>%s<p aria-hidden=\"true\">No.</p><div id='cookieBanner'>We use cookies.</div></div>"):
        assert html.main_text(page % (around % ARTICLE)) == WANT, around
    assert html.main_text("<p aria-hidden=false data-hidden='1' class='x'>Seen.</p>") == "Seen."


def test_deep_and_broken_pages_take_linear_time():
    import time

    n = 100_000
    began = time.monotonic()
    assert html.main_text("<div>w " * n).count("w") == n
    assert html.main_text("<div>w " * n + "</p></b></i>" * n).count("w") == n
    assert html.main_text("<b>" * n + "<p>w" * n).count("w") == n
    assert html.main_text("<ul><li>w" * n).count("w") == n
    html.main_text("<p class='x>w" * n)
    html.main_text('<p class="x>w' * n + "'")
    assert time.monotonic() - began < 60
