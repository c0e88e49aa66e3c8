"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features are the distinct word 1- and 2-grams of a text, hashed to 2^BUCKET_BITS coordinates, each worth
``log(1 + count)``, scaled to length 1, plus a bias. Training takes the features of a bounded sample of labelled texts
to the driver, bounded in texts and in features, and runs FTRL-proximal in small batches; scoring sends the weights to
the executors and takes sparse dot products there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .langid import bounded_sample, id_remainder
from .textnp import FOLD, mixed, segment_hashes, slices

BUCKET_BITS = 18
#: About so many labelled texts are learned from, drawn by a hash of the id.
MAX_LABELLED = 6_000
#: The texts learned from have so many features in all at most (12 bytes each on the driver); a text that does not fit is passed over.
MAX_FEATURES = 20_000_000
#: Passes over the sample: at least MIN_EPOCHS, and as many as make MIN_STEPS examples when it is small.
MIN_EPOCHS, MIN_STEPS, BATCH = 3, 24_000, 16
#: FTRL-proximal: learning rate, its offset, and the strengths of the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.0005, 0.0005
THRESHOLD = 0.3
#: Hash of the 2-gram of a word and itself.
REPEATED = np.uint64(0x5851F42D4C957F2D)

#: Kinds of bytes: 0 white space, 1 letters and bytes beyond ASCII, 2 digits, 3 the rest; a token is a run of one kind.
KIND = np.full(256, 3, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
KIND[0x30:0x3A] = 2


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the texts, by text and bucket; the bias is left to the caller."""
    k = len(offsets) - 1
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, np.zeros(0)
    kind = KIND[data]
    first = np.ones(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    first &= kind > 0
    starts = np.flatnonzero(first)
    if not len(starts):
        return none, none, np.zeros(0)
    inside = kind > 0
    # a run of digits is one token, whatever the number
    shown = FOLD[data]
    shown = np.where(kind == 2, np.uint8(0x30), shown)
    text = np.searchsorted(offsets, starts, "right") - 1
    words = segment_hashes(shown, inside, starts)
    pair = mixed(words[:-1] * np.uint64(3) + words[1:])
    # a word that follows itself is one 2-gram, whatever the word
    pair[words[:-1] == words[1:]] = REPEATED
    same = text[1:] == text[:-1]
    at = np.concatenate([text, text[1:][same]])
    bucket = np.concatenate([words, pair[same]]) >> np.uint64(64 - bits)
    key, count = np.unique((at.astype(np.uint64) << np.uint64(bits)) | bucket, return_counts=True)
    at, bucket = (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(at, weights=value * value, minlength=k))
    return at, bucket, value / norm[at]


class Ftrl:
    """FTRL-proximal for logistic loss; coordinate 2^bits is the bias and carries no penalty."""

    def __init__(self, bits: int = BUCKET_BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        n = (1 << bits) + 1
        self.z, self.n = np.zeros(n), np.zeros(n)
        self.alpha, self.beta, self.bits = alpha, beta, bits
        self.l1, self.l2 = np.full(n, l1), np.full(n, l2)
        self.l1[-1] = self.l2[-1] = 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1[at]) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2[at])
        return np.where(np.abs(z) <= self.l1[at], 0.0, w)

    def learn(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, label: np.ndarray) -> None:
        """One step on a batch: entries (row, bucket, value) with the bias among them, and the rows' labels."""
        at, inverse = np.unique(bucket, return_inverse=True)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[inverse] * value, minlength=len(label)), -35, 35)))
        g = np.bincount(inverse, weights=(p - label)[row] * value, minlength=len(at))
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def extract(rows: DataFrame, text_col: str, extra: list[str]) -> DataFrame:
    """Rows with the sparse features of the text, beside the columns extra."""
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, data in slices(batch.column(batch.num_columns - 1)):
                k = len(offsets) - 1
                at, bucket, value = features(data, offsets)
                cuts = np.searchsorted(at, np.arange(k + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(pa.array(cuts), pa.array(value.astype(np.float32)))]
                part = batch.slice(first, k)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(extra))), *lists], names=[*extra, "buckets", "vals"])

    return rows.select(*extra, F.col(text_col).alias("__text")).mapInArrow(run, f"{fields}, buckets array<int>, vals array<float>")


def _beyond(held: DataFrame, most: int) -> list[int]:
    """Order hashes of the texts to pass over so that the features number at most most."""
    if (held.agg(F.sum(F.size("buckets"))).first()[0] or 0) <= most:
        return []
    total, over = 0, []
    for o, k in held.groupBy("__o").agg(F.sum(F.size("buckets"))).orderBy("__o").toLocalIterator():
        if total + k > most:
            over.append(o)
        else:
            total += k
    return over


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", batch: int = BATCH, max_features: int = MAX_FEATURES) -> np.ndarray:
    """Weights learned from labelled rows (a bounded number), taken in the order of a hash of the id; the last is the bias.

    Labels are 0 or 1; rows with a null label are left out; without rows all weights are 0. An id that repeats counts
    once, with the text of the greatest hash. In that order, texts are passed over that would take the features beyond
    max_features.
    """
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y"), F.col(text_col).alias("__t"))
    one = rows.groupBy("__id").agg(F.max(F.struct(F.xxhash64("__t").alias("h"), "__y", "__t")).alias("r")).select("__id", "r.__y", "r.__t")
    held = cut(extract(one, "__t", ["__id", "__y"]).withColumn("__o", F.xxhash64("__id", F.lit("order"))))
    over = _beyond(held, max_features)
    kept = held.where(~F.col("__o").isin(over)) if over else held
    got = kept.toArrow().sort_by([("__o", "ascending"), ("__id", "ascending")]).combine_chunks()
    model = Ftrl()
    n = got.num_rows
    if not n:
        return model.weights()
    y = got.column("__y").to_numpy()
    lists = got.column("buckets").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    values = got.column("vals").combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    cuts, bucket, value = lists.offsets.to_numpy(), lists.flatten().to_numpy(), values.flatten().to_numpy().astype(float)
    cuts = cuts - cuts[0]
    for _ in range(max(MIN_EPOCHS, -(-MIN_STEPS // n))):
        for a in range(0, n, batch):
            b = min(n, a + batch)
            row = np.repeat(np.arange(b - a), np.diff(cuts[a : b + 1]))
            model.learn(np.concatenate([row, np.arange(b - a)]), np.concatenate([bucket[cuts[a] : cuts[b]], np.full(b - a, 1 << BUCKET_BITS)]), np.concatenate([value[cuts[a] : cuts[b]], np.ones(b - a)]), y[a:b])
    # what Arrow holds of the features would stay with the driver
    del got, lists, values, cuts, bucket, value, row
    pa.default_memory_pool().release_unused()
    return model.weights()


def predict(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Probability of label 1 of each document: doc_id, score.

    A null or empty text, or one of white space, gets the score of the bias; repeated rows are scored one by one; an
    empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, offsets, data in slices(batch.column(1)):
                k = len(offsets) - 1
                at, bucket, value = features(data, offsets)
                dot = np.bincount(at, weights=w[bucket] * value, minlength=k) + w[-1]
                out[first : first + k] = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, score double")


def labelled_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, divisor: int = 5) -> DataFrame:
    """Texts of the training part (crc32 of the id not divisible by divisor) with their quality labels, whose number is bounded and so broadcast."""
    marks = labels.where(F.col("quality").isNotNull() & (id_remainder("doc_id", divisor) != 0)).select("doc_id", F.col("quality").alias("label"))
    return docs.select("doc_id", "text").join(F.broadcast(bounded_sample(marks, "doc_id", max_labelled)), "doc_id")


def op5_quality_scores(spark: SparkSession, sf_dir: str, max_labelled: int = MAX_LABELLED) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = train(labelled_rows(docs, table(spark, sf_dir, "labels"), max_labelled))
    scored = predict(docs, weights)
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
