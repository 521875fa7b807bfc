"""Personal data, plain and disguised, with spans in the source text.

Plain findings use the patterns of the data contract. For disguises a chain of
transducers rewrites the text (homoglyphs and invisible characters, spelled
digits, at/dot words) while every character keeps the source interval that it
stands for; identifiers found in the rewritten text are mapped back through it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Kinds in order and patterns of the data contract.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A number cannot begin inside a run of digits: from there it would have matched at the run's start.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to both sides, which is linear where a search from the left is not."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() < 16:
            continue
        digits = [int(c) for c in m.group() if c not in " -"]
        if 16 <= len(digits) <= 19:
            odd = digits[-1::-2]
            even = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
            if (sum(odd) + sum(even)) % 10 == 0:
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                yield m.span()


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the contract's patterns, by kind as listed, then start."""
    return [(kind, s, e) for kind in KINDS for s, e in FINDERS[kind](text)]


# --- disguises -------------------------------------------------------------

#: Letters of other scripts that look like Latin ones; wide and styled forms come from Unicode's own table.
HOMOGLYPHS = dict(zip(
    "аеорсхуіјѕһԁԛԝАВЕКМНОРСТХУІЈЅ" "οαεικνρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ıɡⅼ",
    "aeopcxyijshdqwABEKMHOPCTXYIJS" "oaeiknptuxABEZHIKMNOPTYX" "igl", strict=True))
INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff")
ODD = re.compile(
    "[\u00ad\u0131\u0261\u0370-\u058f\u200b-\u200f\u2060\u2070-\u209c\u2100-\u218f\u2460-\u24ff"
    "\u3002\ufe52\ufe6b\ufeff\uff01-\uff5e\U0001d400-\U0001d7ff]")

DIGITS = {word: str(n % 10) for n, word in enumerate(
    "zero one two three four five six seven eight nine oh".split())} | {"oh": "0"}
_DIGIT = "(?:" + "|".join(DIGITS) + ")"
#: Runs of at least four spelled digits, so that a number word in prose stays a word.
SPELLED = re.compile(rf"\b{_DIGIT}(?:[\x20,-]{{0,2}}\b{_DIGIT}){{3,}}\b", re.I)
PLUS = re.compile(r"\bplus\x20(?=[0-9])", re.I)
#: A number after a plus of which some digits are words; a single word after the last digits is prose.
MIXED = re.compile(rf"\+(?:[\x20().-]{{0,2}}(?:[0-9]+|\b{_DIGIT}\b)){{2,20}}", re.I)
LAST_WORD = re.compile(rf"(?<=[0-9])[\x20().-]{{1,2}}{_DIGIT}\Z", re.I)
AT = re.compile(
    r"\x20?(?:\(\x20?(?:at|@)\x20?\)|\[\x20?(?:at|@)\x20?\]|\{\x20?(?:at|@)\x20?\}|<at>)\x20?"
    r"|(?<=[A-Za-z0-9])_at_(?=[A-Za-z0-9-]+(?:\.|_dot_|\x20dot\x20|\x20?[(\[{]))", re.I)
DOT = re.compile(
    r"\x20?(?:\(\x20?(?:dot|\.)\x20?\)|\[\x20?(?:dot|\.)\x20?\]|\{\x20?(?:dot|\.)\x20?\}|<dot>)\x20?"
    r"|(?<=[A-Za-z0-9])(?:\x20dot\x20|_dot_)(?=[A-Za-z0-9])", re.I)
#: The bare word may count as @ only before a name with a dot, written or already rewritten.
BARE_AT = re.compile(r"(?<=[A-Za-z0-9])\x20at\x20(?=[A-Za-z0-9-]+\.[A-Za-z])", re.I)
#: What makes "word at host" an address in prose: it is announced, or it stands alone and the word does nothing there.
CUE = re.compile(r"(?:\be?-?mails?|\bcontact|\bwrite to|\breach|\baddress|\bmsg|\bping)\b[^.!?\n]{0,24}\Z", re.I)
ALONE = re.compile(r"(?:\A|[\n:;,<(\"'])\s*\Z")
VERBS = frozenset(
    "look looks looked looking see seen read found find available hosted located live lives based buy sold shop stay meet"
    " visit us me here there online work works worked start stop more order apply register download watch listen published".split())


class Mapped:
    """A text whose characters know the source interval they stand for."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, changes: Iterator[tuple[int, int, str]]) -> None:
        """Put each text in place of its interval; intervals come in order and apart."""
        text, starts, ends, at = [], [], [], 0
        for s, e, new in changes:
            text += (self.text[at:s], new)
            starts += self.starts[at:s]
            ends += self.ends[at:s]
            starts += [self.starts[s]] * len(new)
            ends += [self.ends[e - 1]] * len(new)
            at = e
        if at:
            self.text = "".join((*text, self.text[at:]))
            self.starts, self.ends = [*starts, *self.starts[at:]], [*ends, *self.ends[at:]]

    def source(self, s: int, e: int) -> tuple[int, int]:
        return self.starts[s], self.ends[e - 1]


def _glyphs(text: str) -> Iterator[tuple[int, int, str]]:
    for m in ODD.finditer(text):
        c = m.group()
        new = "" if c in INVISIBLE else HOMOGLYPHS.get(c) or unicodedata.normalize("NFKC", c)
        if new != c and new.isascii():
            yield m.start(), m.end(), new
        elif c == "\u3002":
            yield m.start(), m.end(), "."


def _digits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in SPELLED.finditer(text):
        for word in re.finditer(r"[A-Za-z]+", m.group()):
            yield m.start() + word.start(), m.start() + word.end(), DIGITS[word.group().lower()]


def _joined(text: str) -> Iterator[tuple[int, int, str]]:
    """Single digits apart by one space, as spelling leaves them, closed up after the first."""
    for m in re.finditer(r"(?<![0-9])[0-9](?:[\x20,-]{1,2}[0-9](?![0-9])){3,}", text):
        for gap in re.finditer(r"[\x20,-]+", m.group()):
            yield m.start() + gap.start(), m.start() + gap.end(), ""


def _mixed(text: str) -> Iterator[tuple[int, int, str]]:
    """The spelled digits of numbers after a plus."""
    for m in MIXED.finditer(text):
        number = LAST_WORD.sub("", m.group())
        for word in re.finditer(r"[A-Za-z]+", number):
            yield m.start() + word.start(), m.start() + word.end(), DIGITS[word.group().lower()]


def _bare_at(mapped: "Mapped") -> Iterator[tuple[int, int, str]]:
    """" at " before a host, if more than the word before it speaks for an address."""
    text = mapped.text
    for m in BARE_AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in LOCAL_CHARS:
            start -= 1
        local, host = text[start:m.start()], DOMAIN.match(text, m.end())
        hidden_dot = host and any(
            text[i] == "." and mapped.ends[i] - mapped.starts[i] > 1 for i in range(host.start(), host.end()))
        named = any(c in "0123456789._%+-" for c in local.strip(".-"))
        alone = local.lower() not in VERBS and ALONE.search(text[max(0, start - 8):start]) and not re.match(
            r"\x20[A-Za-z]", text[host.end():host.end() + 2] if host else "")
        if hidden_dot or named or alone or CUE.search(text[max(0, start - 40):start]):
            yield m.start(), m.end(), "@"


def _words(pattern: re.Pattern, new: str):
    return lambda text: ((m.start(), m.end(), new) for m in pattern.finditer(text))


def _disguised(text: str) -> tuple[bool, bool, bool]:
    """Which transducers can change this text; tests that a plain text passes fast."""
    odd = not text.isascii() and ODD.search(text) is not None
    low = text.lower()
    spelled = any(word in low for word in DIGITS if "+" in low or word not in ("one", "oh"))
    signs = ("(at", "( at", "[at", "[ at", "{at", "{ at", "<at>", "(@", "[@", "{@", "( @", "[ @", "_at_", "(.", "[.", "{.", "( .", "[ .")
    marks = "dot" in low or any(x in low for x in signs) or " at " in low and odd
    return odd, spelled, marks or " at " in low and "." in low


def hidden_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows; none lies inside a plain one."""
    odd, spelled, marks = _disguised(text)
    if not (odd or spelled or marks):
        return []
    mapped = Mapped(text)
    if odd:
        mapped.rewrite(_glyphs(mapped.text))
    if spelled or odd:
        before = mapped.text
        mapped.rewrite(_digits(mapped.text))
        if mapped.text != before:
            mapped.rewrite(_joined(mapped.text))
            mapped.rewrite(_words(PLUS, "+")(mapped.text))
        if "+" in mapped.text:
            mapped.rewrite(_mixed(mapped.text))
    if marks or odd:
        for pattern, new in ((AT, "@"), (DOT, ".")):
            mapped.rewrite(_words(pattern, new)(mapped.text))
        mapped.rewrite(_bare_at(mapped))
    if mapped.text == text:
        return []
    found = []
    for kind, s, e in plain_spans(mapped.text):
        span = (kind, *mapped.source(s, e))
        if span[2] - span[1] == e - s and text[span[1]:span[2]] == mapped.text[s:e]:
            continue  # nothing was rewritten in it
        if not any(b <= span[1] and span[2] <= c for _, b, c in plain):
            found.append(span)
    return found


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    line = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    order = lambda x: (KINDS.index(x[0]), x[1], x[2])
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for text in batch.column("text").to_pylist():
            plain = plain_spans(text or "")
            hidden = hidden_spans(text or "", plain)
            for col, kind in zip(out, KINDS):
                col.append(sum(k == kind for k, _, _ in plain))
            out[4].append(hashlib.sha256(line(plain).encode()).hexdigest())
            out[5].append(line(sorted(plain + hidden, key=order)))
            out[6].append(len(hidden))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:4]),
             pa.array(out[4], pa.string()), pa.array(out[5], pa.string()), pa.array(out[6], pa.int64())],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_hidden"])


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the plain spans, and all spans, one row per document row.

    Texts are read one by one inside Arrow batches; nothing is shuffled. Null
    and empty texts have no spans; the digest is then that of an empty text.
    Columns other than doc_id and text are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _report, "doc_id long, n_email long, n_ip long, n_card long, n_phone long,"
                 " base_sha256 string, spans string, n_hidden long")
