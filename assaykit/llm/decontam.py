"""Benchmark decontamination over a positional inverted index.

The terms of the benchmark are counted in the training corpus. Every window of an item is then looked up by its rarest
terms: the index stores the postings (document, position) of these anchor terms with the terms around each position, so
that the offset-adjusted lists of the window's other terms are intersected on the spot, from the rarest outwards. A
posting meets each place of an item where its term stands; the run of equal terms on both sides tells which windows
occur. Only postings of anchor terms leave their row, however long the text is.

A filter of fixed size (one bit a hash value) drops other terms while a text is read; the join by term that follows is
exact. A posting also has a sketch of the words on each side, one of 64 bits for each word, and so has every window of an
item: a window with too many bits that the posting lacks cannot occur there, so most meetings end at a few bit operations.
Words are those of the whole text, ASCII letters in lower case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Consecutive item words that make a window.
WINDOW = 10
#: A proximity match: words that a term may be off its place, and the share of a window (of NEAR_WORDS at least) to be near.
SLACK, NEAR_PCT, NEAR_WORDS = 2, 80, 5
#: Terms of a window that are looked up for proximity; one does for phrases, but a changed passage may lack it.
NEAR_ANCHORS = 2
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The term filter has 2^FILTER_BITS bits.
FILTER_BITS = 17
#: Item places up to this number are broadcast; more are joined by a shuffle.
BROADCAST_PLACES = 200_000


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT), "")


def _bit(word: Column) -> Column:
    """One of 64 bits for a word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(word).bitwiseAND(F.lit(63)).cast("int"))


def _sketch(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))


def _slot(term: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(term), 64 - FILTER_BITS)


def _filter(terms: DataFrame) -> list[int]:
    """The bits of the terms, as 2^(FILTER_BITS - 6) longs whatever the number of terms."""
    rows = terms.select(_slot(F.col("term")).alias("s")).groupBy(F.expr("shiftright(s, 6)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).collect()
    out = [0] * (1 << (FILTER_BITS - 6))
    for r in rows:
        out[r["at"]] = r["bits"]
    return out


def _places(ws: Column, bits: list[int]) -> Column:
    """Positions (from 1) of a word array whose words pass the filter."""
    held = F.array(*(F.lit(b) for b in bits)).cast("array<bigint>")

    def passes(w: Column) -> Column:
        s = F.shiftrightunsigned(F.xxhash64(w), 64 - FILTER_BITS)
        return F.get(held, F.shiftright(s, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(F.lit(63)).cast("int"))) != 0

    return F.filter(F.transform(ws, lambda w, i: F.when(passes(w), i + 1)), lambda i: i.isNotNull())


def item_places(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row for each place of each item: item, row (tells items of one id apart), n (its words), at (from 0), term, left, right, windows (sketches of both sides of those with the place)."""
    named = items.select(F.col(id_col).alias("item"), F.xxhash64(id_col, text_col).alias("row"), words(F.col(text_col)).alias("w")).distinct()
    named = named.where(F.size("w") > 0).withColumn("bits", F.transform("w", _bit)).select("item", "row", "w", "bits", F.posexplode("w").alias("at", "term"))
    width = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.sequence(F.greatest(F.col("at") - width + 1, F.lit(0)), F.least(F.col("at"), F.size("w") - width))
    return named.select(
        "item", "row", F.size("w").alias("n"), "at", "term",
        F.reverse(F.slice("w", F.greatest(F.lit(1), F.col("at") - (WINDOW - 2)), F.least(F.col("at"), F.lit(WINDOW - 1)))).alias("left"),
        F.slice("w", F.col("at") + 2, F.lit(WINDOW - 1)).alias("right"), F.transform(starts, lambda s: F.struct(_sketch(F.slice("bits", s + 1, F.col("at") - s)).alias("left"), _sketch(F.slice("bits", F.col("at") + 2, s + width - 1 - F.col("at"))).alias("right"))).alias("windows"),
    )


def anchors(places: DataFrame, counts: DataFrame, many: int = 1) -> DataFrame:
    """The terms by which windows are looked up: of each, so many of the rarest that occur at all (ties: the term itself decides)."""
    weighed = places.join(counts, "term").select("row", "n", "at", F.when(F.col("df") > 0, F.struct("df", "term")).alias("rank"))
    ahead = Window.partitionBy("row").orderBy("at").rowsBetween(0, WINDOW - 1)
    first = weighed.withColumn("rarest", F.slice(F.array_sort(F.collect_set("rank").over(ahead)), 1, many))
    return first.where((F.col("at") + WINDOW <= F.col("n")) | (F.col("at") == 0)).select(F.explode("rarest.term").alias("term")).distinct()


def _agree(a: Column, b: Column) -> Column:
    """Length of the common prefix of two short arrays."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b)))


def positional_index(docs: DataFrame, terms: list[int], id_col: str, text_col: str) -> DataFrame:
    """Rows of documents with the postings of terms that pass the filter: position, the terms on both sides and their sketch."""
    split = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("of"), words(F.col(text_col)).alias("w"))
    reach = WINDOW - 1 + SLACK
    left = lambda i: F.slice(F.col("w"), F.greatest(F.lit(1), i - reach), F.least(i - 1, F.lit(reach)))
    right = lambda i: F.slice(F.col("w"), i + 1, F.lit(reach))
    posting = lambda i: F.struct(
        i.alias("at"), F.element_at(F.col("w"), i).alias("term"), F.reverse(left(i)).alias("left"), right(i).alias("right"),
        _sketch(F.transform(left(i), _bit)).alias("on_left"), _sketch(F.transform(right(i), _bit)).alias("on_right"),
    )
    return split.select("doc", "of", F.size("w").cast("long").alias("n_words"), F.transform(_places(F.col("w"), terms), posting).alias("postings"))


def _near(item_side: Column, side: Column) -> Column:
    """Whether each word of an item's side stands within SLACK words of its place on the document's side, as 0 and 1."""
    first = lambda i: F.greatest(i + (1 - SLACK), F.lit(1))
    return F.transform(item_side, lambda w, i: F.array_contains(F.slice(side, first(i), i + (2 + SLACK) - first(i)), w).cast("int"))


def _close(n: Column, line: Column) -> Column:
    """Whether a window of the item with the posting's term in it has enough near words; line: a mark for each word around.

    The line is bound by a lambda, or it would be worked out again for each window.
    """
    width = F.least(n, F.lit(WINDOW))
    enough = lambda x, s: F.aggregate(F.slice(x, s, width), F.lit(0), lambda acc, m: acc + m) * 100 >= width * NEAR_PCT
    return (n >= NEAR_WORDS) & F.exists(F.array(line), lambda x: F.exists(F.sequence(F.lit(1), F.size(x) - width + 1), lambda s: enough(x, s)))


def matches(index: DataFrame, places: DataFrame, small: bool, near: bool = False) -> DataFrame:
    """Phrase matches, and proximity matches if near: one row for each posting and item place whose surroundings hold a window.

    Columns: doc, of, item, from, to (positions from 1 of the exact phrase; null where there is none). A term with very
    many postings is met by broadcast, or joined sorted, so that adaptive execution splits it.
    """
    rows = index.select("doc", "of", F.explode("postings").alias("p")).select("doc", "of", "p.*")
    named = places.select("item", "n", F.col("at").alias("item_at"), "term", F.col("left").alias("item_left"), F.col("right").alias("item_right"), "windows")
    met = rows.join(F.broadcast(named) if small else named, "term")
    width = F.least("n", F.lit(WINDOW))
    lacking = F.floor(width * (100 - NEAR_PCT) / 100).cast("int") if near else F.lit(0)
    lacks = lambda i, side: F.bit_count(F.get("windows", F.lit(i))[side].bitwiseAND(F.bitwise_not(F.col(f"on_{side}"))))
    met = met.where(reduce(lambda a, b: a | b, (F.coalesce(lacks(i, "left") + lacks(i, "right") <= lacking, F.lit(False)) for i in range(WINDOW))))
    met = met.withColumns({"l": _agree(F.col("left"), F.col("item_left")), "r": _agree(F.col("right"), F.col("item_right"))})
    whole = (F.col("n") < WINDOW) & (F.col("l") == F.col("item_at")) & (F.col("r") == F.col("n") - 1 - F.col("item_at"))
    phrase = (F.col("l") + F.col("r") + 1 >= WINDOW) | whole
    out = ["doc", "of", "item", F.when(phrase, F.col("at") - F.col("l")).alias("from"), F.when(phrase, F.col("at") + F.col("r")).alias("to")]
    if not near:
        return met.where(phrase).select(*out)
    line = F.concat(F.reverse(_near(F.col("item_left"), F.col("left"))), F.array(F.lit(1)), _near(F.col("item_right"), F.col("right")))
    return met.where(phrase | _close(F.col("n"), line)).select(*out)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", near: bool = False) -> DataFrame:
    """Which words of each document lie in a window of a benchmark item.

    Returns one row a document: doc_id, n_words, n_hit, items (those with an exact phrase, sorted as strings) and, if near
    is asked for, near_items (those with a phrase or a proximity match). An item of fewer words than a window
    is one window; items and texts that are null or without words match nothing; items that share an id count as one, each with
    its own windows. Rows that repeat an id are told apart
    by a hash of the text, and equal rows get equal results; empty tables give an empty result or no hits. Only the
    named columns are read.
    """
    places = cut(item_places(items, item_id_col, item_text_col))
    terms = places.select("term").distinct()
    vocabulary = _filter(terms)
    split = docs.select(words(F.col(text_col)).alias("w"))
    found = split.select(F.explode(F.transform(_places(F.col("w"), vocabulary), lambda i: F.element_at(F.col("w"), i))).alias("term"))
    counts = terms.join(found.groupBy("term").agg(F.count("*").alias("df")), "term")
    chosen = cut(anchors(places, terms.join(counts, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df")), NEAR_ANCHORS if near else 1))
    known = cut(places.join(chosen, "term", "left_semi"))
    index = cut(positional_index(docs, _filter(chosen), id_col, text_col))
    hits = matches(index, known, known.count() <= BROADCAST_PLACES, near)
    spans = hits.groupBy("doc", "of", "item").agg(F.collect_set(F.when(F.col("from").isNotNull(), F.struct("from", "to"))).alias("spans"))
    per_doc = spans.groupBy("doc", "of").agg(
        F.array_sort(F.collect_set(F.when(F.size("spans") > 0, F.col("item").cast("string")))).alias("items"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("near_items"),
        F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("spans")), lambda s: F.sequence(s["from"], s["to"]))))).cast("long").alias("n_hit"),
    )
    left, right = index.select("doc", "of", "n_words").alias("a"), per_doc.alias("b")
    joined = left.join(right, F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.of") == F.col("b.of")), "left")
    return joined.select(F.col("a.doc").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), *(F.coalesce(c, F.expr("cast(array() as array<string>)")).alias(c) for c in ("items", *(["near_items"] if near else []))))


def op10_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact phrases and, beyond the columns that stem from these, the items with a proximity match."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=True)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"), F.array_join("near_items", ",").alias("near_items"),
    )


#: The same in DuckDB: windows of every length that items have, met as strings; proximity from every place of an anchor.
HITS_SQL = """
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce({docs}.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {docs}
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM doc_words, sizes, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k
), met AS (
  SELECT doc_id, item_id, i, k FROM doc_windows JOIN item_windows USING (k, win)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM met, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id
), places AS (
  SELECT item_id, w, len(w) AS n, spot, w[spot + 1] AS term FROM (SELECT DISTINCT item_id, w FROM items WHERE len(w) > 0), unnest(range(len(w))) AS t(spot)
), postings AS (
  SELECT doc_id, i, w[i] AS term FROM doc_words, unnest(range(1, len(w) + 1)) AS t(i)
), counts AS (
  SELECT term, count(*) AS df FROM postings WHERE term IN (SELECT term FROM places) GROUP BY term
), rarest AS (
  SELECT DISTINCT term FROM (
    SELECT term, row_number() OVER (PARTITION BY item_id, w, start ORDER BY df, term) AS place
    FROM (SELECT DISTINCT item_id, w, start, term, df FROM places JOIN counts USING (term), unnest(range(greatest(spot - 9, 0), spot + 1)) AS t(start) WHERE start + 10 <= n OR start = 0)
  ) WHERE place <= 2
), meetings AS (
  SELECT doc_id, i, item_id, n, spot, list_reverse(p.w[greatest(spot - 8, 1):spot]) AS item_left, p.w[spot + 2:spot + 10] AS item_right,
         list_reverse(d.w[greatest(i - 11, 1):i - 1]) AS lefts, d.w[i + 1:i + 11] AS rights
  FROM postings JOIN rarest USING (term) JOIN places p USING (term) JOIN doc_words d USING (doc_id)
), marks AS (
  SELECT doc_id, item_id, least(n, 10) AS k, list_concat(list_concat(
    list_reverse(list_transform(range(1, len(item_left) + 1), lambda o: list_contains(lefts[greatest(o - 2, 1):o + 2], item_left[o])::INT)), [1]),
    list_transform(range(1, len(item_right) + 1), lambda o: list_contains(rights[greatest(o - 2, 1):o + 2], item_right[o])::INT)) AS line
  FROM meetings WHERE n >= 5
), close AS (
  SELECT DISTINCT doc_id, item_id FROM marks WHERE len(list_filter(range(1, len(line) - k + 2), lambda s: list_sum(line[s:s + k - 1]) * 100 >= k * 80)) > 0
  UNION SELECT doc_id, item_id FROM met
), near AS (
  SELECT doc_id, count(*) AS n_near, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS near_ids FROM close GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(near_ids, '') AS near_items
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
"""
