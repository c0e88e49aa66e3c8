"""Ranked lexical search: MaxScore over shards of a compact index.

The index holds a row for each document: its length and the query terms in it with their frequencies; nothing else of the
text is kept. Each task walks through its part of the index in shards of bounded size. A shard inverts its rows into
posting lists and takes, for every query term, the largest contribution in the shard as its upper bound. For each query,
terms are sorted by bound: those whose bounds sum up to less than the k-th best score so far are non-essential, for no
document can qualify by them alone. Documents come from the essential lists only; the non-essential lists are probed from
the largest bound down, and only for documents that can still reach the k-th best score. That score is carried from shard
to shard. What leaves a task is at most k rows a query.

Queries are dealt to blocks by hash, so what a task holds of them is bounded; every block meets all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches, table

#: Documents that a query gets.
K = 20
#: A shard takes index rows up to either number.
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 13
#: Words of the queries of one block, about.
BLOCK_WORDS = 400_000
#: Bytes that separate terms become blanks, A-Z become a-z, all others stay (so do those of code points past ASCII).
FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: A query's terms as they are told apart in JVM plans.
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or b"").translate(FOLD).split()


def words_in(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT), "")


def index(docs: DataFrame, known: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, of (hash of the text), n (terms with repeats), terms and tfs (of the known terms in the text), one row a document."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for b in batches:
            lengths, ends, terms, tfs = [], [0], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                found = terms_of(text)
                lengths.append(len(found))
                for term, tf in Counter(found).items():
                    if (t := number.get(term)) is not None:
                        terms.append(t)
                        tfs.append(tf)
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("of"), pa.array(lengths, pa.int64()), *lists], names=["doc", "of", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("of"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        return cut(rows.mapInArrow(encode, "doc long, of long, n long, terms array<int>, tfs array<int>"))


class Best:
    """The k best documents of a query so far: higher scores first, then smaller ids (null last)."""

    __slots__ = ("k", "rows", "floor")

    def __init__(self, k: int):
        self.k, self.floor = k, 0
        self.rows = np.empty((0, 4), np.int64)  # score, id is null, id, hash of the text

    def take(self, rows: np.ndarray) -> None:
        rows = np.concatenate([self.rows, rows])
        if len(rows) > self.k:
            rows = rows[rows[:, 0] >= np.partition(rows[:, 0], -self.k)[-self.k]]
        self.rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]
        if len(self.rows) == self.k:
            self.floor = int(self.rows[-1, 0])


def maxscore(lists: list[tuple[np.ndarray, np.ndarray]], bounds: np.ndarray, n_docs: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that score floor and above 0 at least, with their scores.

    lists: of each term, documents (ascending) and what the term adds to each; bounds: the most that a term adds.
    """
    order = np.argsort(bounds, kind="stable")
    upto = np.cumsum(bounds[order])  # the most that a document gets from this term and those of smaller bounds
    first = int(np.searchsorted(upto, floor, "left"))  # terms before it are non-essential
    score = np.zeros(n_docs, np.int64)
    for t in order[first:]:
        docs, adds = lists[t]
        score[docs] += adds
    may = np.flatnonzero(score)
    for j in range(first - 1, -1, -1):
        may = may[score[may] + upto[j] >= floor]
        if not len(may):
            break
        docs, adds = lists[order[j]]
        at = np.minimum(np.searchsorted(docs, may), len(docs) - 1)
        there = docs[at] == may
        score[may[there]] += adds[at[there]]
    may = may[score[may] >= max(floor, 1)]
    return may, score[may]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Index rows in pieces of bounded size: ids are null, ids, hashes, m, postings' terms, documents and frequencies."""
    held, docs, postings = [], 0, 0
    for b in batches:
        sizes = np.diff(b.column("terms").offsets.to_numpy())
        at = 0
        while at < len(sizes):
            fits = np.searchsorted(np.cumsum(sizes[at : at + SHARD_DOCS - docs]), SHARD_POSTINGS - postings, "right")
            upto = at + max(int(fits), 0 if held else 1)
            if upto > at:
                held.append(b.slice(at, upto - at))
                docs, postings = docs + upto - at, postings + int(sizes[at:upto].sum())
            at = upto
            if at < len(sizes):  # the shard is full
                yield _opened(held)
                held, docs, postings = [], 0, 0
    if held:
        yield _opened(held)


def _opened(held: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    t = pa.Table.from_batches(held).combine_chunks()
    one = lambda c: t.column(c).combine_chunks()
    sizes = np.diff(one("terms").offsets.to_numpy())
    null = one("doc").is_null().to_numpy(zero_copy_only=False)
    flat = lambda c: one(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return null, one("doc").fill_null(0).to_numpy(), one("of").to_numpy(), one("m").to_numpy(), flat("terms"), np.repeat(np.arange(len(sizes)), sizes), flat("tfs")


def ranked(rows: DataFrame, asked: list[dict[int, int]], weights: list[int], k: int) -> DataFrame:
    """The k best documents of each query in each task: query (its place in asked), doc, of, score.

    rows: index rows with m; asked: of each query, its terms and their repeats; weights: by term.
    """
    sent = rows.sparkSession.sparkContext.broadcast(([(np.fromiter(q, np.int64, len(q)), np.fromiter(q.values(), np.int64, len(q))) for q in asked], np.array(weights, np.int64)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, w = sent.value
        best = [Best(k) for _ in queries]
        for null, ids, of, m, term, doc, tf in _shards(batches):
            order = np.argsort(term, kind="stable")
            term, doc, tf = term[order], doc[order], tf[order]
            adds = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            there, starts = np.unique(term, return_index=True)
            ends = np.append(starts[1:], len(term))
            most = np.maximum.reduceat(adds, starts) if len(term) else adds
            place = np.full(len(w), -1)
            place[there] = np.arange(len(there))
            for q, (terms, times) in enumerate(queries):
                at = place[terms]
                own = np.flatnonzero(at >= 0)
                if not len(own):
                    continue
                lists = [(doc[starts[i] : ends[i]], adds[starts[i] : ends[i]] * n) for i, n in zip(at[own], times[own])]
                found, score = maxscore(lists, most[at[own]] * times[own], len(ids), best[q].floor)
                if len(found):
                    best[q].take(np.stack([score, null[found].astype(np.int64), ids[found], of[found]], 1))
        out = np.concatenate([b.rows for b in best]) if best else np.empty((0, 4), np.int64)
        numbers = np.repeat(np.arange(len(best)), [len(b.rows) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(out[:, 2], mask=out[:, 1] == 1), pa.array(out[:, 3]), pa.array(out[:, 0])], names=["query", "doc", "of", "score"])

    return rows.select("doc", "of", "m", "terms", "tfs").mapInArrow(search, "query int, doc long, of long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The k documents that score highest for each item: item_id, rank (from 1), doc_id, score.

    A document without terms (null, empty) matches nothing, an item without terms has no row, and neither has an item of
    which no term scores. Equal scores rank by id, a null id last, then by a hash of the text; rows that repeat an id and
    text rank one after the other. Items that repeat id and text count once; items that share an id only are ranked each
    by itself. Ids of documents are whole numbers. Only the named columns are read.
    """
    spark = docs.sparkSession
    named = cut(items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct().select("item_id", "text", F.size(words_in(F.col("text"))).alias("words")).where("words > 0"))
    blocks = -(-int(named.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]) // block_words)
    parts = []
    for block in range(blocks):
        own = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").collect()
        counts = [Counter(terms_of(r["text"].encode())) for r in own]
        known = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        rows = index(docs, known, id_col, text_col)
        n_docs, n_terms = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = [int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1)))) for i in range(len(known))]
        m = F.expr(f"cast(75 + ((25 * cast(n AS DECIMAL(20,0)) * {n_docs}BD) div {max(n_terms, 1)}BD) AS BIGINT)")
        found = ranked(rows.where("n > 0").withColumn("m", m), [{known[t]: n for t, n in c.items()} for c in counts], weights, k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", named.schema["item_id"].dataType)]))
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc"), "of")
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        parts.append(top.join(F.broadcast(names), "query").select("item_id", "rank", F.col("doc").alias("doc_id"), "score"))
    if not parts:
        return named.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same in DuckDB, every document scored.
RANKED_SQL = """
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n_terms FROM tfs GROUP BY doc_id),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n_terms)::BIGINT AS all_terms FROM lengths),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tfs, corpus GROUP BY term, docs),
scores AS (
  SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n_terms * docs) // all_terms))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus GROUP BY item_id, doc_id
), placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 20
"""
