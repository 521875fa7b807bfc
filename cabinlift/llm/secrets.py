"""Secret scan with multipart credential linking, in DataFrame expressions only.

Strong findings (``assign``, ``access``, ``hex``) stand on their own. Weak parts
say little alone: a long mixed token (``key``), a named identifier (``login``)
and a service address (``endpoint``). A weak part is reported only if a
complementary part lies in its scope, an interval of ``scope`` code points to
either side: ``key`` and ``inline`` (a password inside an address) need an
identifier or an endpoint, ``login`` and ``endpoint`` need a secret. Parts are
joined by interval in two sweeps over their places, one from either end, so the
work grows with their number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cabinlift.llm.columns import digest, let, places, scanned

# The patterns of the data contract, in its order.
ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")

# Weak parts. Keys are long mixed runs, or tokens that begin with the mark of a service.
KEY = (
    r"(?<![A-Za-z0-9+/=_-])(?:"
    r"(?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])(?=[0-9A-Z+/]*[a-z])[A-Za-z0-9+/]{32,}+={0,2}+"
    r"|(?:gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|[sr]k_(?:live|test)_|pk_live_|npm_|pypi-|hf_|dop_v1_|shpat_|SG\.)[A-Za-z0-9_.-]{16,}+"
    r"|AIza[A-Za-z0-9_-]{30,}+"
    r"|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+"
    r")(?![A-Za-z0-9+/=_-])")
#: What every key has: a long run of its characters, looked for from the run's start, or a mark.
LONG_RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32}"
MARKS = ("glpat-", "xox", "pypi-", "SG.", "AIza", "eyJ")
#: Marks with an underscore, which most texts do not have at all.
UNDERSCORED = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "k_live_", "k_test_", "npm_", "hf_", "dop_v1_", "shpat_")
LOGIN = r"(?i)\b(?:user(?:name)?|login|client_?id|access_?key(?:_?id)?|account)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}"
#: A password inside an address: it stands between the name and the host.
INLINE = r"(?<=://[A-Za-z0-9._~-]{1,64}:)[^\x00-\x20:/@\"'<>]{4,}(?=@[A-Za-z0-9.-])"
ENDPOINT = r"(?i)\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/@-]{4,}"
WEAK = ("key", "login", "endpoint", "inline")
KINDS = BASE + WEAK

#: Code points to either side in which a complementary part counts.
SCOPE = 200

#: Beyond any place in a text.
FAR = 1 << 30

IDENTIFIERS, SECRETS = ("access", "login"), ("assign", "hex", "key", "inline")


def _found(text: Column, pattern: str, kind: str, hint: Column) -> Column:
    """Places of ``pattern`` as kind, s, e; ``hint`` is a cheap test that every match passes."""
    spans = F.transform(
        places(text, F.lit(pattern)),
        lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")),
    )
    return F.when(hint & text.rlike(pattern), spans).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<kind:string,s:int,e:int>>")


def _assigns(text: Column) -> Column:
    """Assignments whose value is long enough; shorter ones are consumed and dropped."""
    spans = F.filter(
        F.zip_with(
            places(text, F.lit(ASSIGN)), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)),
            lambda x, value: F.struct(
                F.lit("assign").alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.length(value).alias("n")),
        ),
        lambda x: x["n"] >= ASSIGN_LEAST,
    )
    spans = F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return F.when(_sets(text) & text.rlike(ASSIGN), spans).otherwise(_none())


def _sets(text: Column) -> Column:
    """Something is set to something: a sign that every assignment and login has."""
    return text.contains("=") | text.contains(":")


def _near(spans: Column, other: Callable[[Column], Column], of: Callable[[Column], Column], scope: int, near: bool = True) -> Column:
    """The spans that ``of`` picks with one of the others within ``scope``; without ``near`` those with none.

    By their places: of the others that start no later the one that ends last is
    asked, and of those that start later the first.
    """
    order = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), F.when(other(x), 0).otherwise(1).alias("part"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def decide(xs: Column) -> Column:
        seen = lambda state, x: state
        last = scanned(xs, F.lit(-FAR), lambda state, x: F.when(x["part"] == 0, F.greatest(state, x["e"])).otherwise(state), seen)
        first = F.reverse(scanned(
            F.reverse(xs), F.lit(FAR), lambda state, x: F.when(x["part"] == 0, x["s"]).otherwise(state), seen))
        sides = F.zip_with(last, first, lambda a, b: F.struct(a.alias("last"), b.alias("first")))
        met = F.zip_with(xs, sides, lambda x, y: F.struct(
            x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"),
            ((y["last"] > x["s"] - scope) | (y["first"] < x["e"] + scope)).alias("met")))
        picked = F.filter(met, lambda x: of(x) & (x["met"] if near else ~x["met"]))
        return F.transform(picked, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    return let(order, decide)


def _any_mark(text: Column) -> Column:
    """Whether the mark of a service occurs."""
    either = lambda marks: reduce(or_, [text.contains(mark) for mark in marks])
    return either(MARKS) | text.contains("_") & either(UNDERSCORED)


def _linked(parts: Column, scope: int) -> Column:
    """The weak parts that have a complementary part in scope."""
    named = lambda x: x["kind"].isin(*IDENTIFIERS, "endpoint")
    secret = lambda x: x["kind"].isin(*SECRETS)
    return F.concat(
        _near(parts, named, lambda x: x["kind"].isin("key", "inline"), scope),
        _near(parts, secret, lambda x: x["kind"].isin("login", "endpoint"), scope))


def _apart(weak: Column, strong: Column) -> Column:
    """Weak spans that touch no strong one; what a strong span covers is already reported."""
    is_strong = lambda x: x["kind"].isin(*BASE)
    return _near(F.concat(strong, weak), is_strong, lambda x: ~is_strong(x), 0, near=False)


def _written(spans: Column) -> Column:
    rank = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), F.array_position(rank, x["kind"]).alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string")))


def find_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with ``strong`` and ``weak``, arrays of struct(kind, s, e) in code points.

    One row in, one row out; other columns pass through, and columns that are
    already called ``strong`` or ``weak`` are replaced. Null and empty texts
    have no spans. Repeated rows get the same spans each.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    strong = F.concat(_assigns(body), _found(body, ACCESS, "access", body.contains("AKIA")),
                      _found(body, HEX, "hex", F.lit(True)))
    docs = docs.withColumn("strong", strong)
    hints = F.concat(
        _found(body, KEY, "key", body.rlike(LONG_RUN) | _any_mark(body)), _found(body, LOGIN, "login", _sets(body)),
        _found(body, ENDPOINT, "endpoint", body.contains("://")),
        _found(body, INLINE, "inline", body.contains("://") & body.contains("@")))
    docs = docs.withColumn("weak", hints)
    apart = F.when(F.size("strong") > 0, _apart(F.col("weak"), F.col("strong"))).otherwise(F.col("weak"))
    linked = _linked(F.concat(F.col("strong"), apart), scope)
    return docs.withColumn("weak", F.when(F.size("weak") > 0, linked).otherwise(_none()))


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the strong spans, and all spans, one row per document row."""
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("strong", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind in BASE],
        digest(_written(F.col("strong"))).alias("base_sha256"),
        F.array_join(_written(F.concat("strong", "weak")), ",").alias("spans"),
        F.size("weak").cast("long").alias("n_weak"),
    )
