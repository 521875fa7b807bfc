"""Plain versions of what the operators compute, one row at a time."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long, digest string, line string, n string"


def documents(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = ids or range(len(texts))
    sources = sources or ["s"] * len(texts)
    rows = [(i, t, "en", s, len(t or ""), "x", "y", "z") for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


class Groups:
    """Union-find for a handful of items; the smallest item names its group."""

    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
