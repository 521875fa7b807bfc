"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text with their root-to-leaf tag path.
Elements that are no text by their kind (navigation, forms, scripts, hidden
parts) are set aside. For every path the text and punctuation per text node are
summed; both ratios are smoothed over the page, fused, and compared with their
spread. Blocks of paths above the threshold vote for the container they stand
in. Containers whose class names them furniture go; if it only names them a part
of the layout, such as a sidebar, the votes may still find the page's text in
them. The article is the nearest article or main element around the best
container, or else the lowest container that holds all those blocks; all its
blocks are kept, so a heading, a lead or a shorter part stays with the text it
belongs to.

Pages are independent, so the work is one pass over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements without an end tag, and elements whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
#: Elements that break the running text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td"
    " tfoot th thead tr ul".split())
#: Elements that are furniture wherever they stand.
FURNITURE = frozenset("nav aside footer form button select option input dialog menu head object canvas".split())
#: Elements that can hold an article; a quotation is part of one.
CONTAINER = frozenset("article main section div td body html center".split())
#: Containers that say of themselves that they hold the whole article.
WHOLE = ("article", "main")
#: What may not stand inside what: a start tag closes an open element of its kind up to the given limits.
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
          "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPES = frozenset("article aside blockquote body div dl fieldset form html main ol section table td th ul".split())
#: Words of a class, id or role that mark furniture: as the whole name, as its last word (site-footer), or
#: before the name of a part (comment-list). Words only, so that "shadow" is no "ad".
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion comment comments disqus"
    " respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe"
    " subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer masthead"
    " share sharing social related recommended recommendations pagination pager toolbar skip hidden".split())
PARTS = frozenset(
    "area bar block body box bottom button container content form frame group holder inner item items left link links list"
    " outer panel posts region right row section slot space stories top unit wrap wrapper zone".split())
#: Names that tell of a state or of the layout around, not of the element itself.
STATES = frozenset("no not non without with has have is are js can hide show single open".split())
STATE_ENDS = frozenset("open closed on off enabled disabled allowed active count".split())
#: Marks that hold whatever the votes say: readers, adverts and notices may write more than the author.
FIRM = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion comment comments disqus"
    " respond reply replies cookie cookies consent gdpr notice notices alert nav navbar navigation menu".split())
#: Share of the voted text that a marked container needs to be taken for the page's text.
MOST = 0.6
#: The same for elements that hold a page's top: a heading in them is furniture unless it stands in an article.
HEADER = frozenset(("header", "hgroup"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
#: A tag whose quotes do not match.
LOOSE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…、。，؟।]")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _mark(name: str) -> str:
    """The word by which a class, id or role names furniture; empty if it does not."""
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    if not words or len(words) > 1 and (words[0] in STATES or words[-1] in STATE_ENDS):
        return ""
    if words[-1] in MARKS:
        return words[-1]
    return words[0] if len(words) > 1 and words[0] in MARKS and words[-1] in PARTS else ""


def _read(name: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is furniture or hidden whatever is in it, and the word by which it names itself so."""
    mark = ""
    for key, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and HIDING.search(value):
            return True, ""
        if key in ("class", "id", "role", "data-role"):
            mark = next((m for m in map(_mark, value.split()) if m), mark)
    return name in FURNITURE, mark


class Page:
    """The elements of a page, numbered as they begin, and its blocks of text.

    Everything an element passes on to what stands in it is worked out once, when
    it begins, so the work grows with the page and not with its depth.
    """

    def __init__(self) -> None:
        self.parent, self.path, self.container, self.whole = [0], [0], [0], [0]
        self.marked, self.marks, self.gone = [0], [""], [False]
        self._paths: dict[tuple[int, str], int] = {}
        #: Text and number of the innermost element of each block.
        self.texts: list[str] = []
        self.at: list[int] = []

    def element(self, parent: int, name: str, gone: bool, mark: str) -> int:
        """A new element: with its path of block names, nearest container, article and marked element, itself included."""
        number = len(self.parent)
        path = self.path[parent]
        if name in BLOCK:
            path = self._paths.setdefault((path, name), len(self._paths) + 1)
        mark = mark if name not in ("html", "body", *WHOLE) else ""
        self.parent.append(parent)
        self.path.append(path)
        self.container.append(number if name in CONTAINER else self.container[parent])
        self.whole.append(number if name in WHOLE else self.whole[parent])
        self.marked.append(number if mark else self.marked[parent])
        self.marks.append(mark)
        self.gone.append(gone and name not in ("html", "body", *WHOLE) or self.gone[parent])
        return number

    def sums(self, values: dict[int, float]) -> list[float]:
        """Per element, the values given for it and for all elements in it."""
        total = [0.0] * len(self.parent)
        for number, value in values.items():
            total[number] += value
        for number in range(len(total) - 1, 0, -1):
            total[self.parent[number]] += total[number]
        return total

    def around(self, number: int) -> Iterator[int]:
        """The element and those it stands in, inside out."""
        while number:
            yield number
            number = self.parent[number]


def read_page(page: str) -> Page:
    """The blocks of a page in order, but for those that are furniture by their kind."""
    tree = Page()
    open_: list[tuple[str, int]] = []  # name and number
    places: dict[str, list[int]] = {}  # where in ``open_`` each name stands
    scopes: list[int] = []  # where what limits an implied end stands
    pieces: list[str] = []
    tops = headings = 0  # open page headers and headings
    at = 0

    def flush() -> None:
        text = SPACE.sub(" ", unescape("".join(pieces))).strip()
        pieces.clear()
        here = open_[-1][1] if open_ else 0
        if text and not tree.gone[here] and not (tops and not (headings and tree.whole[here])):
            tree.texts.append(text)
            tree.at.append(here)

    def close(depth: int) -> None:
        nonlocal tops, headings
        for name, _ in open_[depth:]:
            places[name].pop()
            tops -= name in HEADER
            headings -= name in HEADINGS
        while scopes and scopes[-1] >= depth:
            scopes.pop()
        del open_[depth:]

    while at < len(page):
        less = page.find("<", at)
        if less < 0:
            pieces.append(page[at:])
            break
        pieces.append(page[at:less])
        token = TOKEN.match(page, less) or LOOSE.match(page, less)
        if not token:
            pieces.append("<")
            at = less + 1
            continue
        at = token.end()
        closing, name, attributes = token.group(1), token.group(2), token.group(3) or ""
        if name is None:
            if token.group().startswith("<![CDATA["):
                pieces.append(token.group()[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if closing:
            if places.get(name):
                depth = places[name][-1]
                if name in BLOCK or any(x in BLOCK or tree.gone[n] or tree.marks[n] for x, n in open_[depth:]):
                    flush()
                close(depth)
            continue
        if name in RAW and not attributes.endswith("/"):
            at = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at).end()
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCK or name in FURNITURE:
            flush()
            ended = max((places[inner][-1] for inner, by in CLOSES.items() if name in by and places.get(inner)), default=-1)
            if ended >= 0 and ended >= (scopes[-1] if scopes else 0):
                close(ended)
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        gone, mark = _read(name, attributes)
        if (gone or mark) and name not in BLOCK:
            flush()
        places.setdefault(name, []).append(len(open_))
        if name in SCOPES:
            scopes.append(len(open_))
        open_.append((name, tree.element(open_[-1][1] if open_ else 0, name, gone, mark)))
        tops += name in HEADER
        headings += name in HEADINGS
    flush()
    return tree


def _smooth(x: np.ndarray) -> np.ndarray:
    """Mean over neighbours with the weights 1 2 3 2 1, less at the ends."""
    weights = np.array([1.0, 2, 3, 2, 1])
    return np.convolve(x, weights, "same") / np.convolve(np.ones(len(x)), weights, "same") if len(x) >= 5 else x


def path_scores(texts: list[str], paths: list[int]) -> np.ndarray:
    """Per block, the fused ratio of its path: text and punctuation per text node, smoothed over the page."""
    sums: dict[int, list[float]] = {}
    for text, path in zip(texts, paths):
        s = sums.setdefault(path, [0.0, 0.0, 0.0])
        s[0] += len(text)
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += 1
    size = _smooth(np.array([sums[p][0] / sums[p][2] for p in paths]))
    marks = _smooth(np.array([sums[p][1] / sums[p][2] for p in paths]))
    return size * (1 + marks)


def _votes(tree: Page, blocks: list[int]) -> dict[int, float]:
    """Length of the text of the chosen blocks, by the element they stand in."""
    scores = path_scores([tree.texts[i] for i in blocks], [tree.path[tree.at[i]] for i in blocks])
    votes: dict[int, float] = {}
    for i, good in zip(blocks, scores >= min(scores.std(), scores.max())):
        if good:
            votes[tree.at[i]] = votes.get(tree.at[i], 0.0) + len(tree.texts[i])
    return votes


def _unmarked(tree: Page) -> list[int]:
    """The blocks without those in marked containers that the votes do not take for the page's text."""
    blocks = list(range(len(tree.texts)))
    if not blocks or len(tree.marks) == tree.marks.count(""):
        return blocks
    votes = _votes(tree, blocks)
    held, total = tree.sums(votes), sum(votes.values())
    # Per element, whether it or one around it is marked; parents come before what stands in them.
    out = [False] * len(tree.parent)
    for n in range(1, len(out)):
        mark = tree.marks[n]
        out[n] = out[tree.parent[n]] or bool(mark) and (mark in FIRM or held[n] < MOST * total)
    return [i for i in blocks if not out[tree.at[i]]]


def main_text(page: str | None) -> str:
    """The article's blocks joined by line breaks; empty if the page has no text."""
    tree = read_page(page or "")
    blocks = _unmarked(tree)
    if not blocks:
        return ""
    votes = _votes(tree, blocks)
    held, total = tree.sums(votes), sum(votes.values())
    inside = {n for n in tree.container if n}
    # The deepest container that holds most of the chosen text, directly or inside; of several the last to begin.
    best = max((n for n in inside if held[n] >= 0.6 * total and held[n] > 0), default=None)
    if best is None:
        direct: dict[int, float] = {}
        for n, size in votes.items():
            direct[tree.container[n]] = direct.get(tree.container[n], 0.0) + size
        best = max((n for n in direct if n), key=direct.get, default=None)
    if best is None:
        return "\n".join(tree.texts[i] for i in blocks)
    # From there outwards to the article it is a part of; without one, the page is the article.
    around = [n for n in tree.around(best) if n in inside]
    best = tree.whole[best] or next((n for n in around if held[n] == total), 0)
    # Per element, whether it is the article or stands in it.
    part = [best == 0] * len(tree.parent)
    for n in range(1, len(part)):
        part[n] = n == best or part[tree.parent[n]]
    return "\n".join(tree.texts[i] for i in blocks if part[tree.at[i]])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row per row of ``pages``.

    Null and empty pages have an empty text. Other columns are not read, and
    repeated rows are read one by one.
    """
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
