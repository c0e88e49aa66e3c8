"""Secret scans: patterns of known secrets, and sliding-window entropy over other candidate strings.

A candidate is a long run of the characters of a class. A window slides over it; of each window the Shannon entropy is
``log2(n) - sum(c log2 c) / n`` over the counts c of its characters. The counts and the sum are carried from window to
window: one count goes down, one goes up, and the sum changes by those two. A candidate is reported if its best window
reaches the threshold of its class and no entry of the allow list holds.

Positions are code points: a text is split by a pattern, and the lengths of the pieces and the matches between them
add up to starts and ends, block by block, so that a text of very many matches costs in proportion to them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from string import ascii_letters, digits

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex")
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}+"
MIN_ASSIGNED = 8


@dataclass(frozen=True)
class CharClass:
    """Runs of the pattern are candidates; window is the width, threshold the least entropy in bits a character.

    alphabet holds every character of a candidate, but for closing "=".
    """

    name: str
    pattern: str
    window: int
    threshold: float
    alphabet: str


#: Runs of one class; a run must hold a digit and a letter, so that words and numbers are no candidates.
CLASSES = (
    CharClass("base64", r"[A-Za-z0-9+/_-]{24,}+={0,2}", 20, 3.6, ascii_letters + digits + "+/_-"),
    CharClass("hexmixed", r"(?<![A-Za-z0-9+/_-])[0-9A-F]{32,}+", 32, 3.0, digits + "ABCDEF"),
)
#: Candidates that match one of these are suppressed: identifiers in five groups, words of one case with separators,
#: counting sequences, samples that call themselves so.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]++(?:[/_-][A-Za-z]*+)*+[0-9]{0,4}$",
    r"(?i)example|sample|placeholder|dummy|xxxx",
    r"0123456789|abcdefghij",
)


#: Values of one block of a running total.
BLOCK = 64


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value made once: as an element of an array it is one object, whatever refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,stop:int,kind:int,hit:string>>)")


def _short_scan(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What op makes of start and all values before each place; copies what it has for each value, so for few of them."""
    step = lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("out")), step, lambda acc: acc["out"])


def _scan(values: Column, start: int, op: Callable[[Column, Column], Column]) -> Column:
    """The same for an array of any length: block totals first, then the places of each block. op is associative, start neutral."""

    def blockwise(v: Column) -> Column:
        part = lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(start), op))
        return F.when(F.size(v) > 0, F.flatten(F.transform(_short_scan(totals, F.lit(start), op), lambda at, b: _short_scan(part(b), at, op)))).otherwise(F.expr("cast(array() as array<int>)"))

    return _with(values, blockwise)


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Matches as array<struct<start, stop, kind, hit>> in text order."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(pieces, found, lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("width"), m.alias("hit")))
    steps = F.filter(steps, lambda s: s["hit"].isNotNull())
    span = lambda at, s: F.struct((at + s["gap"]).alias("start"), (at + s["gap"] + s["width"]).alias("stop"), F.lit(kind).alias("kind"), s["hit"].alias("hit"))
    return _with(steps, lambda own: F.zip_with(_scan(F.transform(own, lambda s: s["gap"] + s["width"]), 0, lambda x, y: x + y), own, span))


def _apart(spans: Column, kinds: int) -> Column:
    """Sorted spans without those of a kind from kinds on that overlap one of a kind before."""
    last = 2**31 - 1

    def kept(s: Column) -> Column:
        before = _scan(F.transform(s, lambda m: F.when(m["kind"] < kinds, m["stop"]).otherwise(0)), 0, lambda x, y: F.greatest(x, y))
        after = _scan(F.reverse(F.transform(s, lambda m: F.when(m["kind"] < kinds, m["start"]).otherwise(last))), last, lambda x, y: F.least(x, y))
        sides = F.zip_with(before, F.reverse(after), lambda x, y: F.struct(x.alias("ended"), y.alias("next")))
        return _with(sides, lambda side: F.filter(s, lambda m, i: (m["kind"] < kinds) | ((F.get(side, i)["ended"] <= m["start"]) & (F.get(side, i)["next"] >= m["stop"]))))

    return _with(spans, kept)


def _clog(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(F.greatest(n, F.lit(1)))).otherwise(0.0)


def best_entropy(s: Column, window: int, alphabet: str) -> Column:
    """The largest entropy of a window of s, in bits a character; s has at least window characters, all of the alphabet."""

    def slid(codes: Column) -> Column:
        first = F.slice(codes, 1, window)
        counts = F.transform(F.sequence(F.lit(1), F.lit(len(alphabet))), lambda c: F.size(F.filter(first, lambda x: x == c)))
        total = F.aggregate(counts, F.lit(0.0), lambda acc, n: acc + _clog(n))

        def slide(acc: Column, i: Column) -> Column:
            # the window that begins at i (from 0) gives up its first character and takes the next
            leaves, enters = F.get(codes, i) - 1, F.get(codes, i + window) - 1
            n, m = F.get(acc["counts"], leaves), F.get(acc["counts"], enters)
            now = F.when(leaves == enters, acc["sum"]).otherwise(acc["sum"] - _clog(n) + _clog(n - 1) - _clog(m) + _clog(m + 1))
            counts = F.transform(acc["counts"], lambda x, c: x - (c == leaves).cast("int") + (c == enters).cast("int"))
            return F.struct(counts.alias("counts"), now.alias("sum"), F.least(acc["least"], now).alias("least"))

        start = F.struct(counts.alias("counts"), total.alias("sum"), total.alias("least"))
        steps = F.when(F.size(codes) > window, F.sequence(F.lit(0), F.size(codes) - window - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.aggregate(steps, start, slide, lambda acc: F.log2(F.lit(float(window))) - acc["least"] / float(window))

    return _with(F.transform(F.split(s, ""), lambda c: F.instr(F.lit(alphabet), c)), slid)


def _suspicious(hit: Column, c: CharClass) -> Column:
    body = F.regexp_replace(hit, "=+$", "")
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | body.rlike(pattern)
    mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z]")
    return F.when(mixed & ~allowed, best_entropy(body, c.window, c.alphabet) >= c.threshold).otherwise(False)


def _surprising(found: Column, c: CharClass) -> Column:
    return F.filter(found, lambda m: _suspicious(m["hit"], c))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES) -> DataFrame:
    """Spans of secrets in each document.

    Returns one row a document: doc_id and spans, an array of (start, stop, kind, hit) by start, then kind; kind is 0
    to 2 for the patterns KINDS, then 3 and up for the entropy classes. Pattern matches are leftmost and do not overlap
    within a kind; an entropy span that overlaps a pattern's span is left out, the pattern's stays. A null or empty
    text has no spans; repeated rows are scanned one by one; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("__t"))
    t = F.col("__t")
    assigned = F.filter(_matches(t, ASSIGN, 0), lambda m: F.char_length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= MIN_ASSIGNED)
    rows = rows.select(
        "doc_id",
        "__t",
        F.when(t.rlike(ASSIGN), assigned).otherwise(_none()).alias("__a"),
        F.when(t.rlike(ACCESS), _matches(t, ACCESS, 1)).otherwise(_none()).alias("__k"),
        F.when(t.rlike(HEX), _matches(t, HEX, 2)).otherwise(_none()).alias("__h"),
        *(F.when(t.rlike(c.pattern), _surprising(_matches(t, c.pattern, 3 + n), c)).otherwise(_none()).alias(f"__e{n}") for n, c in enumerate(classes)),
    )
    base = F.concat("__a", "__k", "__h")
    rows = rows.select("doc_id", F.array_sort(base).alias("base"), F.flatten(F.array(*(F.col(f"__e{n}") for n in range(len(classes))))).alias("more"))
    spans = F.when(F.size("more") > 0, _apart(F.array_sort(F.concat("base", "more")), len(KINDS))).otherwise(F.col("base"))
    return rows.select("doc_id", "base", spans.alias("spans"))


def _listed(spans: Column, names: tuple[str, ...]) -> Column:
    kinds = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op6_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = KINDS + tuple(c.name for c in CLASSES)
    found = scan(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(_listed(F.col("base"), names), 256).alias("base_sha256"), _listed(F.col("spans"), names).alias("spans"),
    )
