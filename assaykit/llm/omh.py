"""Document fingerprints by Order MinHash.

The elements of a text are its k-mers of words, numbered by occurrence: the second occurrence of a k-mer is another
element than the first. Each of SKETCHES orders of the elements (a common hash, with the bits of a mask turned) picks
the ELL smallest; they are put back into text order and the tuple of their k-mers is hashed. Two texts agree in a
component if they pick the same k-mers in the same order, so the share of equal components falls with edit distance,
not only with the overlap of the sets.

Everything stays in array expressions of one row. An element is one long: 38 bits of its hash, then 26 bits of its
position, so minima carry their place along; runs of equal k-mers, found by sorting, give the occurrence numbers.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

K, ELL, SKETCHES = 2, 2, 16
POSITION_BITS = 26
SPLIT = r"[\x20\x09-\x0D]+"


def _masks(n: int) -> list[int]:
    """Fixed masks over the hash bits of an element."""
    digests = (int.from_bytes(hashlib.sha256(f"order {i}".encode()).digest()[:8], "big", signed=True) for i in range(n))
    return [(d >> POSITION_BITS) << POSITION_BITS for d in digests]


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _high(h: Column) -> Column:
    return F.shiftleft(F.shiftright(h, POSITION_BITS), POSITION_BITS)


def _kmers(text: Column, k: int) -> Column:
    """Hashes of the k-mers of a text's words, in text order; a text of fewer words is one k-mer, one of none has none."""

    def of(words: Column) -> Column:
        n = F.size(words)
        gram = lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k)))
        return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), gram)).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return _let(F.array_remove(F.split(text, SPLIT), ""), of)


def _elements(kmers: Column) -> Column:
    """Elements of the k-mers: hash of (k-mer, occurrence number) above the position."""
    at = F.transform(kmers, lambda h, i: _high(h).bitwiseOR(i.cast("long")))

    def numbered(s: Column) -> Column:
        n = F.size(s)
        heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (_high(F.get(s, i)) != _high(F.get(s, i - 1))))

        def occurrences(h: Column) -> Column:
            ends = F.concat(F.slice(h, F.lit(2), F.size(h)), F.array(n))
            return F.flatten(F.zip_with(h, ends, lambda a, b: F.sequence(F.lit(0), b - a - 1)))

        return F.when(n == 0, s).otherwise(
            F.zip_with(s, _let(heads, occurrences), lambda x, o: _high(F.xxhash64(F.shiftright(x, POSITION_BITS), o)).bitwiseOR(x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))))
        )

    return _let(F.sort_array(at), numbered)


def signature(text: Column, k: int = K, ell: int = ELL, sketches: int = SKETCHES) -> Column:
    """The components of the Order MinHash of a text, an array of longs; empty for a text without words."""

    def all_of(kmers: Column) -> Column:
        def components(elements: Column) -> Column:
            def component(mask: Column) -> Column:
                def smallest(turned: Column) -> Column:
                    picked, rest = [], turned
                    for _ in range(ell):
                        picked.append(F.array_min(rest))
                        rest = F.array_remove(rest, picked[-1])
                    place = lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
                    return F.sort_array(F.filter(F.array(*map(place, picked)), lambda p: p.isNotNull()))

                turned = F.transform(elements, lambda x: x.bitwiseXOR(mask))
                return F.xxhash64(F.transform(_let(turned, smallest), lambda p: F.get(kmers, p.cast("int"))))

            return F.transform(F.array(*map(F.lit, _masks(sketches))), component)

        return _let(_elements(kmers), components)

    kmers = _kmers(text, k)
    return _let(kmers, lambda h: F.when(F.size(h) > 0, all_of(h)).otherwise(F.expr("cast(array() as array<bigint>)")))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components; two texts without words are alike, one without words is like no other."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(equal / F.size(a))


def shown(a: Column) -> Column:
    """A signature as hexadecimal digits, 16 a component."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def numbered(keys: DataFrame, *order: Column) -> DataFrame:
    """The rows with their number from 0 in the given order, by sorted ranges and the counts of those before."""
    cols = keys.columns
    spread = cut(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy(part.alias("__part")).count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    return spread.withColumn("__part", part).join(starts, "__part").select(*cols, (F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias("__n"))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each document with its signature, its edited text and the signature of the next document.

    Documents stand by id descending (then by a hash of the text), the first after the last. Only ids and lengths are
    sorted; then each document sends the beginning of its text, as long as the one before needs, to that document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("of", F.xxhash64("text"))
    signed = cut(rows.select("id", "of", F.char_length("text").cast("long").alias("n"), signature(F.col("text")).alias("sig")))
    order = cut(numbered(signed.dropDuplicates(["id", "of"]), F.col("id").desc_nulls_last(), F.col("of")))
    total = order.count()
    after = order.select(F.pmod(F.col("__n") - 1, F.lit(max(1, total))).alias("__m"), F.col("id").alias("next_id"), F.col("of").alias("next_of"), F.col("sig").alias("next_sig"))
    asked = order.join(after, F.col("__n") == F.col("__m")).select(
        "next_id", "next_of", "next_sig", F.col("id").alias("for_id"), F.col("of").alias("for_of"), "sig", F.floor(F.col("n") / 3).cast("int").alias("take")
    )
    met = rows.dropDuplicates(["id", "of"]) if total < signed.count() else rows
    met = met.join(asked, F.col("id").eqNullSafe(F.col("next_id")) & (F.col("of") == F.col("next_of")))
    sent = met.select("for_id", "for_of", F.substr("text", F.lit(1), F.col("take")).alias("head"), "sig", "next_sig")
    joined = rows.join(sent, F.col("id").eqNullSafe(F.col("for_id")) & (F.col("of") == F.col("for_of")))
    kept = F.char_length("text") - F.floor(F.char_length("text") / 3).cast("int")
    return joined.select("id", "sig", "next_sig", F.char_length("text").cast("long").alias("n_chars"), F.concat(F.substr("text", F.lit(1), kept), F.col("head")).alias("edited"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness.

    Returns one row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A null text counts as empty; a text without words has the empty fingerprint; rows equal in id and text
    are one document in the order and share their result; a single document is its own next; an empty table gives an
    empty result.
    """
    rows = with_next(docs, id_col, text_col).withColumn("edited_sig", signature(F.col("edited")))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), shown(F.col("sig")).alias("fingerprint"),
        shown(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
