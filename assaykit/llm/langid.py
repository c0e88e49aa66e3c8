"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams by language inside each partition (numpy), adds the counts up by (language, bucket) and sends
the log-probability matrix, whose size is languages x buckets, to the executors. A text is scored by the sparse sum of
the matrix rows of its n-grams.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textnp import mixed, slices

#: Orders of n-grams; spaces mark the borders of words.
ORDERS = (1, 2, 3)
BUCKET_BITS = 15
#: About so many labelled rows are learned from, drawn by a hash of the id.
MAX_LABELLED = 20_000
SMOOTHING = 0.5
#: The score is the posterior as if a text had at most so many n-grams, as they are not independent.
EVIDENCE = 40.0
UNDETERMINED = "und"


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Small letter of each code point that is a letter, else a space."""
    out = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BUCKET_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the n-grams of the texts; those of spaces only do not count."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != len(at):
        raise ValueError("the column does not hold UTF-8")
    text = (np.searchsorted(offsets, at, "right") - 1).astype(np.int32)
    letters = _letters()[points]
    # one space between words and between texts
    keep = letters != 0x20
    follows = np.ones(len(keep), bool)
    follows[1:] = keep[:-1] & (text[1:] == text[:-1])
    keep |= follows
    letters, text = letters[keep].astype(np.uint64), text[keep]
    for n in orders:
        if len(letters) < n:
            continue
        m = len(letters) - n + 1
        h = np.full(m, n, np.uint64)
        some = np.zeros(m, bool)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + letters[i : i + m]
            some |= letters[i : i + m] != 0x20
        ok = some & (text[:m] == text[n - 1 :])
        yield text[:m][ok], (mixed(h[ok]) >> np.uint64(64 - bits)).astype(np.int64)


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", smoothing: float = SMOOTHING) -> dict:
    """Log-probabilities of the n-grams by language. labelled: rows with a label; a null text counts nothing.

    The result has the sorted labels and a float32 matrix buckets x labels; without rows it has no labels.
    """
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for first, offsets, data in slices(batch.column(0)):
                names = sorted(set(labels[first : first + len(offsets) - 1]))
                code = np.array([names.index(x) for x in labels[first : first + len(offsets) - 1]], np.int64)
                for text, bucket in ngram_buckets(data, offsets) if len(data) else ():
                    found = np.bincount(code[text] * size + bucket, minlength=size * len(names)).reshape(-1, size)
                    for name, row in zip(names, found, strict=True):
                        totals[name] = totals.get(name, 0) + row
        for name, row in totals.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"label": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(row[at], pa.int64())})

    rows = labelled.select(F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l")).where(F.col("l").isNotNull())
    counts = rows.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(set(counts["label"]))
    matrix = np.full((size, len(labels)), smoothing)
    np.add.at(matrix, (counts["bucket"].to_numpy(), counts["label"].map({x: i for i, x in enumerate(labels)}).to_numpy(int)), counts["n"].to_numpy(float))
    matrix = np.log(matrix) - np.log(matrix.sum(0, keepdims=True)) if labels else matrix
    return {"labels": labels, "matrix": matrix.astype(np.float32)}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language and score of each document: doc_id, lang_pred, score.

    The score is the posterior probability of the language for at most EVIDENCE n-grams of the text's average kind
    (uniform prior). A null text, one without letters, or a model without labels gives ``und`` with score 0; ties go to
    the first label; repeated rows are scored one by one; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model["labels"], model["matrix"]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, matrix = sent.value
        for batch in batches:
            n = batch.num_rows
            pred, top = np.full(n, -1), np.zeros(n)
            for first, offsets, data in slices(batch.column(1)):
                k = len(offsets) - 1
                sums, grams = np.zeros((k, len(labels))), np.zeros(k)
                for text, bucket in ngram_buckets(data, offsets) if len(data) and labels else ():
                    grams += np.bincount(text, minlength=k)
                    for j in range(len(labels)):
                        sums[:, j] += np.bincount(text, weights=matrix[bucket, j], minlength=k)
                some = grams > 0
                z = sums[some] / grams[some, None] * np.minimum(grams[some], EVIDENCE)[:, None]
                if len(z):
                    p = np.exp(z - z.max(1, keepdims=True))
                    pred[first : first + k][some] = z.argmax(1)
                    top[first : first + k][some] = p.max(1) / p.sum(1)
            names = np.array([*labels, UNDETERMINED], object)[pred]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(top)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def bounded_sample(rows: DataFrame, id_col: str, limit: int) -> DataFrame:
    """About limit rows at most, drawn by a hash of the id."""
    n = rows.count()
    if n <= limit:
        return rows
    bits = math.floor(limit / n * (1 << 30))
    return rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) < bits)


def id_remainder(id_col: str, divisor: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % divisor


def op1_language_id(spark: SparkSession, sf_dir: str, max_labelled: int = MAX_LABELLED) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.where(F.col("lang").isNotNull() & (id_remainder("doc_id", 4) != 2))
    model = train(bounded_sample(known, "doc_id", max_labelled))
    return predict(docs, model).select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
