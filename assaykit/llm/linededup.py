"""Fuzzy line dedup by MinHash.

Lines that are equal fall into one class. The signature of a class is the MinHash of the 9-byte windows of its line:
a window of 9 bytes lies within 9 characters, so lines of equal character shingles have equal windows, whatever their
length, script and spaces. Bands of the signature give candidates, which are verified by the exact Jaccard similarity of
their sets of character shingles; verified links are united, and one line of each component stays: the first by document
and place.

Everything is expressions. A line is cut into pieces of PIECE windows by an explode, and each piece is a row of plain
columns that stay in generated code; minima over a class are partial aggregates. Members of a band's list meet its first
member only, so a large group of copies costs one pair a member; where that leaves several components, each member meets
one further member that its minima choose. Of lists that still hold several components, short ones
are paired across components; the members of all longer ones go through an exact prefix join: shingles are ordered from
rare to frequent, and two lines can be similar only if they share one of the first few of each. Shingles that one
component alone holds come first and make no pairs, so lines that share a passage and are too far apart meet nobody.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordering import let_go
from .common import broadcast_if_small, cut, table
from .components import components

#: Characters of a shingle, and the similarity of a link.
SHINGLE, NUM, DEN = 9, 80, 100
#: Windows hashed in one row; more of them make code that the JVM does not compile.
PIECE = 8
#: Minima of a signature. A pair's similarity is the chance of each to be equal; one of 0.8 has fewer than LEAST_ALIKE
#: equal with a probability of 0.00006 and is not verified then, if a band alone proposes it.
MINIMA, LEAST_ALIKE = 12, 4
#: Bands take the minima i, i + 1 and i + 4 (mod MINIMA), so two bands share one at most: a pair of similarity 0.8 meets
#: in a band with a probability of 0.993, one of 0.9 with 0.9998.
STEPS = (0, 1, 4)
#: Lists of more members are not paired: their members go to the prefix join.
LONG = 16
#: Rare shingles beside one in its line that tell whether a pair shares an earlier one.
NEIGHBOURS = 2

#: Bytes of lines or sets that are broadcast for the exact check; more of them are shuffled.
BROADCAST_BYTES = 32 << 20

MASKS = [int.from_bytes(hashlib.sha256(f"line {i}".encode()).digest()[:8], "big", signed=True) for i in range(MINIMA)]


def _windows(lines: DataFrame, piece: int) -> DataFrame:
    """key and the hashes h0, h1, ... of a piece of the windows of its line, a row for each piece."""
    windows = F.greatest(F.octet_length("b") - (SHINGLE - 1), F.lit(1))
    whole = lines.select("key", F.col("line").cast("binary").alias("b")).select("key", "b", windows.alias("n"))
    pieces = whole.select("key", "b", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / piece).cast("int"))).alias("c"))
    # a last piece repeats its last window, which changes no minimum
    places = [F.least(F.col("c") * piece + (j + 1), F.col("n")) for j in range(piece)]
    return pieces.select("key", *(F.xxhash64(F.substr("b", at, F.lit(SHINGLE))).alias(f"h{j}") for j, at in enumerate(places)))


def _least(i: int, piece: int) -> Column:
    """The i-th minimum of a piece: its hashes in the order that a mask gives them."""
    return F.shiftright(F.least(*(F.col(f"h{j}").bitwiseXOR(F.lit(MASKS[i])) for j in range(piece))), 32).cast("int").alias(f"m{i}")


def signatures(lines: DataFrame) -> DataFrame:
    """key and the minima m0, m1, ... of each class of lines (key, line)."""
    least = _windows(lines, PIECE).select("key", *(_least(i, PIECE) for i in range(MINIMA)))
    return least.groupBy("key").agg(*(F.min(f"m{i}").alias(f"m{i}") for i in range(MINIMA)))


def _bands() -> Column:
    """The grams of all bands, each with the number of its band."""
    return F.explode(F.array(*(F.xxhash64(F.lit(i), *(f"m{(i + s) % MINIMA}" for s in STEPS)) for i in range(MINIMA)))).alias("gram")


def _lists(members: DataFrame) -> DataFrame:
    """Members (gram, key) of lists of several, each with the list's first member and its length: gram, key, head, c."""
    heads = broadcast_if_small(members.groupBy("gram").agg(F.min("key").alias("head"), F.count("*").alias("c")).where(F.col("c") > 1))
    let_go(members.sparkSession)
    return cut(members.join(heads, "gram"))


def _shingles(line: Column) -> Column:
    """Hashes of the character shingles of a line; a shorter line is one shingle.

    In UTF-32 any place is read at once. As an element of an array the encoded line is one object for all places: a column
    would be copied for each.
    """
    at = lambda p: F.sequence(F.lit(1), F.greatest(F.octet_length(p) - 4 * SHINGLE, F.lit(0)) + 1, F.lit(4))
    return F.get(F.transform(F.array(F.encode(line, "UTF-32")), lambda p: F.transform(at(p), lambda i: F.xxhash64(F.substr(p, i, F.lit(4 * SHINGLE))))), F.lit(0))


def _few(texts: DataFrame, times: int) -> bool:
    """Whether so many times the bytes of the texts, and their minima, are few enough for a broadcast."""
    size = F.sum(F.octet_length("line") * F.lit(times).cast("long") + 16 * MINIMA)
    return (texts.agg(size).first()[0] or 0) <= BROADCAST_BYTES


def _alike(x: str, y: str) -> Column:
    """How many minima are equal."""
    return sum(((F.col(x.format(i)) == F.col(y.format(i))).cast("int") for i in range(MINIMA)), F.lit(0))


def verify(pairs: DataFrame, texts: DataFrame, num: int = NUM, den: int = DEN, least: int = LEAST_ALIKE) -> DataFrame:
    """The pairs (a, b) of keys whose lines have a similarity of num/den or more; texts: key, line and minima.

    Pairs with fewer than least equal minima are not compared; 0 compares all. A hot key is joined sorted, so that adaptive execution splits it.
    """
    minima = [f"m{i}" for i in range(MINIMA)]
    seconds = texts.join(broadcast_if_small(pairs.select(F.col("b").alias("key")).distinct()), "key", "left_semi")
    y = seconds.select(F.col("key").alias("b"), F.struct("line", *minima).alias("y"))
    # the set of a pair's first line is made once for all its pairs, that of the second in the last join
    firsts = texts.join(broadcast_if_small(pairs.select(F.col("a").alias("key")).distinct()), "key", "left_semi")
    x = firsts.select(F.col("key").alias("a"), F.array_distinct(_shingles(F.col("line"))).alias("set"), F.struct(*minima).alias("x"))
    # a set takes eight bytes a character
    both = pairs.join(F.broadcast(y) if _few(seconds, 1) else y, "b").join(F.broadcast(x) if _few(firsts, 8) else x, "a")
    # exploded, so that the set is made once and not again in each place that refers to it
    sets = both.where(_alike("x.m{}", "y.m{}") >= least).select("a", "b", "set", F.explode(F.array(F.array_distinct(_shingles(F.col("y.line"))))).alias("other"))
    shared = sets.select("a", "b", (F.size("set") + F.size("other")).alias("n"), F.size(F.array_intersect("set", "other")).alias("c"))
    return shared.where(F.col("c") * den >= (F.col("n") - F.col("c")) * num).select("a", "b")


def _open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of lists that hold several components: gram, key, c, comp."""
    placed = lists.where(F.col("c") > 2).join(broadcast_if_small(roots), F.col("key") == F.col("node"), "left").select("gram", "key", "c", F.coalesce("root", "key").alias("comp"))
    several = placed.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("gram")
    return cut(placed.join(broadcast_if_small(several), "gram", "left_semi"))


def _likest(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Of pairs (key, k2), for each key the one whose minima are the most alike: a, b."""
    minima = [f"m{i}" for i in range(MINIMA)]
    other = signed.select(F.col("key").alias("k2"), *(F.col(m).alias(f"{m}_2") for m in minima))
    best = F.max_by("k2", F.struct(_alike("m{}", "m{}_2"), "k2")).alias("k2")
    chosen = pairs.join(signed.select("key", *minima), "key").join(other, "k2").groupBy("key").agg(best)
    return chosen.select(F.least("key", "k2").alias("a"), F.greatest("key", "k2").alias("b")).distinct()


def _guided(opened: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b): each member of lists that hold several components with the likest of its lists' guides.

    Guides are two members of each list, drawn by a hash; those of the member's own component do not count.
    """
    drawn = F.struct(F.xxhash64("gram", "key").alias("h"), "key", "comp")
    guides = opened.groupBy("gram").agg(F.array(F.min(drawn), F.max(drawn)).alias("guides"))
    met = opened.join(guides, "gram").select("key", "comp", F.explode("guides").alias("g")).where(F.col("g.comp") != F.col("comp"))
    return _likest(met.select("key", F.col("g.key").alias("k2")).distinct(), signed)


def _across(opened: DataFrame, signed: DataFrame, least: int = LEAST_ALIKE) -> DataFrame:
    """Pairs of different components within short lists, with at least so many equal minima."""
    minima = [f"m{i}" for i in range(MINIMA)]
    marked = cut(opened.join(signed, "key").select("gram", "key", "comp", *minima))
    other = marked.select("gram", F.col("key").alias("k2"), F.col("comp").alias("comp2"), *(F.col(m).alias(f"{m}_2") for m in minima))
    met = marked.join(other, "gram").where((F.col("key") < F.col("k2")) & (F.col("comp") != F.col("comp2")) & (_alike("m{}", "m{}_2") >= least))
    return met.select(F.col("key").alias("a"), F.col("k2").alias("b")).distinct()


def _prefixes(crowd: DataFrame, num: int, den: int) -> DataFrame:
    """The rarest shingles of each line of a crowd (key, comp, line): t, key, comp, n (of the set), p (place in the order), earlier.

    Shingles of one component only are the rarest; they take their places and get no row, as they make no pairs. Of the
    NEIGHBOURS rows before and after a shingle's in the line, earlier has the shingles that come before it in the order.
    """
    sets = crowd.select("key", "comp", F.explode(F.array(F.array_distinct(_shingles(F.col("line"))))).alias("set"))
    each = sets.select("key", "comp", F.size("set").alias("n"), F.posexplode("set").alias("i", "t"))
    held = each.groupBy("t").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi"))
    ordered = each.join(held.select("t", "c"), "t").groupBy("key", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t", "i"))).alias("ts"))
    own = F.col("n") - F.size("ts")
    first = F.expr(f"n - (n * {num}L + {den - 1}) div {den} + 1").cast("int")
    ranked = F.transform(F.slice("ts", F.lit(1), F.greatest(first - own, F.lit(0))), lambda s, r: F.struct(s["i"].alias("i"), r.alias("r"), s["t"].alias("t")))

    def row(by: Column, s: Column, j: Column) -> Column:
        beside = F.array(*(F.get(by, j + d) for d in range(-NEIGHBOURS, NEIGHBOURS + 1) if d))
        return F.struct(s["t"].alias("t"), s["r"].alias("r"), F.transform(F.filter(beside, lambda o: o["r"] < s["r"]), lambda o: o["t"]).alias("earlier"))

    # as an element of an array, what is sorted by place is made once
    rows = F.get(F.transform(F.array(F.sort_array(ranked)), lambda by: F.transform(by, lambda s, j: row(by, s, j))), F.lit(0))
    posted = ordered.select("key", "comp", "n", own.alias("own"), F.explode(rows).alias("s"))
    return posted.select(F.col("s.t").alias("t"), "key", "comp", "n", (F.col("own") + F.col("s.r")).alias("p"), F.col("s.earlier").alias("earlier"))


def _meetings(crowd: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) by each rare shingle at which they meet, the first one that they share among them; see :func:`prefix_pairs`."""
    x = cut(_prefixes(crowd, num, den))
    index = x.where(F.expr(f"p <= n - (n * {2 * num}L + {num + den - 1}) div {num + den}"))
    y = index.select("t", F.col("key").alias("k2"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("p").alias("p2"), F.col("earlier").alias("earlier2"))
    larger = (F.col("n2") < F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("k2") < F.col("key")))
    left = F.least(F.col("n") - F.col("p"), F.col("n2") - F.col("p2")).cast("long")
    fits = (F.col("n2").cast("long") * den >= F.col("n").cast("long") * num) & (left * (num + den) >= (F.col("n") + F.col("n2")).cast("long") * num)
    # with an earlier shingle in common this one is not the first, at which the pair meets anyway
    again = F.arrays_overlap("earlier", "earlier2")
    met = x.join(y, "t").where((F.col("comp") != F.col("comp2")) & larger & fits & ~again)
    return met.select(F.least("key", "k2").alias("a"), F.greatest("key", "k2").alias("b"))


def prefix_pairs(crowd: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Pairs (a, b) of a crowd (key, comp, line) that may be similar and are of different components: none is lost.

    Of two similar sets the larger one's first n - num/den n + 1 shingles and the smaller one's first n - 2 num/(num + den) n
    + 1 share one. The first that they share must leave enough shingles behind it in both for the overlap that the sizes ask
    for. Shingles of a common passage stand side by side, so most that are not the first show it by their neighbours.
    """
    return _meetings(crowd, num, den).distinct()


def linked_lines(named: DataFrame, num: int = NUM, den: int = DEN, long: int = LONG, least: int = LEAST_ALIKE) -> DataFrame:
    """Components of the classes of lines (key, line): node, root; classes without a link are absent.

    The members of each band's list are linked to its first member. Of lists that hold several components then, those of up
    to long members are paired across components; the members of longer ones are joined by prefixes, which loses nothing.
    Pairs that bands propose are compared if at least so many minima are equal (0: all).
    """
    signed = cut(signatures(named))
    let_go(named.sparkSession)
    lists = _lists(signed.select("key", _bands()))
    let_go(named.sparkSession)
    wanted = broadcast_if_small(lists.select("key").distinct())
    texts = cut(named.join(wanted, "key", "left_semi").groupBy("key").agg(F.any_value("line").alias("line")).join(signed.join(wanted, "key", "left_semi"), "key"))
    stars = cut(lists.where(F.col("key") != F.col("head")).select(F.col("head").alias("a"), F.col("key").alias("b")).distinct())
    let_go(named.sparkSession)
    roots = components(verify(stars, texts, num, den, least))
    opened = _open(lists, roots)
    del signed, lists, wanted
    let_go(named.sparkSession)
    found = verify(cut(_guided(opened, texts)), texts, num, den, least)
    roots = components(found.union(roots.select("node", "root")))
    opened = _open(opened.drop("comp"), roots)
    let_go(named.sparkSession)
    short = cut(_across(opened.where(F.col("c") <= long), texts, least).join(stars, ["a", "b"], "left_anti"))
    edges = roots.select("node", "root").union(verify(short, texts, num, den, 0))
    crowd = broadcast_if_small(opened.where(F.col("c") > long).select("key", "comp").distinct())
    if crowd.isEmpty():
        return components(edges)
    del opened
    let_go(named.sparkSession)
    near = cut(prefix_pairs(texts.select("key", "line").join(crowd, "key"), num, den))
    let_go(named.sparkSession)
    both = near.select(F.col("a").alias("key"), F.col("b").alias("k2")).union(near.select("b", "a"))
    roots = components(edges.union(verify(cut(_likest(both, texts)), texts, num, den, 0)))
    rest = verify(cut(_apart(near, roots)), texts, num, den, 0)
    return components(rest.union(roots.select("node", "root")))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one component yet."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return known.where(~F.coalesce(F.col("root_a"), F.col("a")).eqNullSafe(F.coalesce(F.col("root_b"), F.col("b")))).select("a", "b")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(text).alias("at", "raw")).select("doc", "at", F.trim("raw").alias("line"))


def line_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line with its component and whether it stays.

    Returns one row a line: doc_id, line_no (from 0), line_key, component, keep. Blank lines are all kept and have no
    component (null); a null text is one blank line. The line that stays is the first of its component by doc_id (null
    first), then line_no; of rows that repeat an id, lines at one place share their fate. Lines of equal shingle sets
    (repeated tokens, rules of different length) have similarity 1. An empty table gives an empty result.
    """
    lines = _lines(docs, id_col, text_col)
    some = F.col("line") != ""
    base = lines.select("doc", "at", F.when(some, F.xxhash64("line")).alias("key"))
    roots = linked_lines(lines.where(some).select(F.xxhash64("line").alias("key"), "line"))
    comp = base.join(broadcast_if_small(roots), F.col("key") == F.col("node"), "left").select("doc", "at", "key", F.coalesce("root", "key").alias("component"))
    # only components of several lines need their first one looked up
    shared = comp.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("c")).where(F.col("c") > 1)
    out = comp.join(broadcast_if_small(shared.select("component", "first")), "component", "left")
    stays = F.col("first").isNull() | (F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("at") == F.col("first.at")))
    return out.select(F.col("doc").alias("doc_id"), F.col("at").alias("line_no"), F.col("key").alias("line_key"), "component", stays.alias("keep"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the lines that do not stay: doc_id, n_lines, n_kept, text.

    Blank lines stay; the text of a document that loses all its lines is empty; a null text comes back empty. Rows that
    repeat an id are one document here: its lines follow each other by place.
    """
    marks = line_components(docs, id_col, text_col).select(F.col("doc_id").alias("d"), F.col("line_no").alias("l"), "keep").distinct()
    lines = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("at", "raw"))
    held = lines.join(marks, F.col("doc").eqNullSafe(F.col("d")) & (F.col("at") == F.col("l")))
    parts = held.groupBy("doc").agg(F.count("*").alias("n_lines"), F.count_if("keep").alias("n_kept"), F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("at", "raw")))).alias("p"))
    return parts.select(F.col("doc").alias("doc_id"), "n_lines", "n_kept", F.array_join(F.col("p.raw"), "\n").alias("text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_components(table(spark, sf_dir, "documents"))
