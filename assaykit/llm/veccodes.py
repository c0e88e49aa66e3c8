"""Compressed vector codes: product codebooks whose nearest entries are found by VA-file filtering.

A vector of whole numbers is cut into parts; each part is coded by the nearest of the entries of its position's codebook.
The coordinates of the entries are quantised to a few bits: each dimension has cells between quantiles of the entries'
coordinates. For a part to be coded, a table for each dimension holds the squared distance to the near and to the far side
of every cell; sums of looked-up values are lower and upper bounds of its distance to an entry, without reading the entry.
Only entries whose lower bound does not exceed the smallest upper bound are compared, by exact integer distances.

Codebooks are learned by rounds of assignment and averaging. A task sums what it assigns, so a round shuffles a few
hundred rows a task; codebooks have a fixed size and are broadcast. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, table

#: Parts of a vector, entries of a codebook, rounds of learning, units of a component.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of a cell number.
CELL_BITS = 3
#: Components are held within this bound, so that distances fit 64 bits.
BOUND = 1 << 27


class Cells:
    """A codebook's entries with their cells: bounds of distances by table lookups, exact ones for what overlaps."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries
        ranks = np.linspace(0, len(entries) - 1, (1 << bits) + 1).round().astype(int)
        self.edges = np.sort(entries, axis=0)[ranks].T  # dimension, edge; the first and last are the extremes
        inner = self.edges[:, 1:-1]
        self.cell = np.stack([np.searchsorted(inner[d], entries[:, d], "right") for d in range(entries.shape[1])], 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of and squared distance to the nearest entry of each row (ties: the lower index), and how many were refined."""
        low, high = x[:, :, None] - self.edges[None, :, 1:], self.edges[None, :, :-1] - x[:, :, None]
        near = np.maximum(np.maximum(low, high), 0) ** 2  # row, dimension, cell
        far = np.maximum(np.abs(x[:, :, None] - self.edges[None, :, :-1]), np.abs(x[:, :, None] - self.edges[None, :, 1:])) ** 2
        at_least, at_most = np.zeros((len(x), len(self.entries)), np.int64), np.zeros((len(x), len(self.entries)), np.int64)
        for d in range(x.shape[1]):
            at_least += near[:, d, self.cell[:, d]]
            at_most += far[:, d, self.cell[:, d]]
        row, entry = np.nonzero(at_least <= at_most.min(1)[:, None])
        exact = ((x[row] - self.entries[entry]) ** 2).sum(1)
        starts = np.searchsorted(row, np.arange(len(x)))
        best = np.minimum.reduceat(exact, starts)
        ties = np.where(exact == best[row], entry, len(self.entries))
        return np.minimum.reduceat(ties, starts), best, len(row)


def _whole(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows whose vector has finite components only, as whole numbers: id, x, label."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    whole = F.transform(v, lambda e: F.floor(F.greatest(F.least(e, F.lit(BOUND / SCALE)), F.lit(-BOUND / SCALE)) * SCALE).cast("long"))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & fine).select(F.col(id_col).alias("id"), whole.alias("x"), F.col(label_col).alias("label"))


def _matrix(b: pa.RecordBatch, dims: int) -> np.ndarray:
    """Vectors of a batch, padded to whole parts: row, part, place."""
    x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, dims)
    width = -(-dims // PARTS)
    return np.pad(x, ((0, 0), (0, width * PARTS - dims))).reshape(len(x), PARTS, width)


def assigned(rows: DataFrame, dims: int, books: np.ndarray) -> DataFrame:
    """id, label, code (hex digits in part order), error (squared distances, summed) of each row."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(e) for e in sent.value]
        for b in batches:
            if b.num_rows:
                x = _matrix(b, dims)
                found = [c.nearest(x[:, p]) for p, c in enumerate(cells)]
                codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(sum(f[1] for f in found))], names=["id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("id", "label", "x").mapInArrow(encode, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def averaged(rows: DataFrame, dims: int, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry is the floor of the mean of its parts; unused entries stay."""
    sent, width = rows.sparkSession.sparkContext.broadcast(books), books.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(e) for e in sent.value]
        total, count = np.zeros(sent.value.shape, np.int64), np.zeros(sent.value.shape[:2], np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b, dims)
                for p, c in enumerate(cells):
                    at = c.nearest(x[:, p])[0]
                    np.add.at(total[p], at, x[:, p])
                    count[p] += np.bincount(at, minlength=len(count[p]))
        used = np.argwhere(count)
        if len(used):
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(total[used[:, 0], used[:, 1]].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used[:, 0]), pa.array(used[:, 1]), pa.array(count[used[:, 0], used[:, 1]]), values], names=["part", "entry", "n", "total"])

    partial = rows.select("x").mapInArrow(sums, "part long, entry long, n long, total array<long>")
    whole = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(width))).alias("total"))
    new = books.copy()
    for r in whole.collect():  # at most PARTS x ENTRIES rows
        new[r["part"], r["entry"]] = [int(t) // r["n"] for t in r["total"]]
    return new


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors and the codebooks (part, entry, place): vec_id, code, error, label_error.

    Rows whose vector is null or empty, or holds null or non-finite components, are dropped, and so are vectors that are
    not as long as the one of the smallest id. Components are floor(256 x), held within +-2^27. A length that the parts do
    not divide is padded with zeros. Codebooks start from the smallest ids (ties by the vector; null ids last); with fewer
    vectors than entries, books have as many entries as there are vectors. Rows that repeat are coded each. No rows give an
    empty result and empty books. label_error sums the error over equal labels, null ones together.
    """
    every = cut(_whole(vectors, id_col, vector_col, label_col))
    order = [F.asc_nulls_last("id"), "x"]
    lead = every.orderBy(*order).select(F.size("x")).first()
    dims = lead[0] if lead else PARTS
    rows = every.where(F.size("x") == dims)
    first = rows.orderBy(*order).limit(ENTRIES).select("x").collect()
    width = -(-dims // PARTS)
    if not first:
        empty = every.select(F.col("id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty, np.zeros((PARTS, 0, width), np.int64)
    start = np.array([[*r["x"], *[0] * (width * PARTS - dims)] for r in first], np.int64)
    books = start.reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = averaged(rows, dims, books)
    coded = cut(assigned(rows, dims, books))
    labels = broadcast_if_small(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    out = coded.join(labels, coded["label"].eqNullSafe(labels["of"]))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compress(table(spark, sf_dir, "embeddings"))
    return out.withColumn("codebooks_sha256", F.lit(digest(books)))


def _sql() -> str:
    """The same in DuckDB: every part meets every entry."""
    steps = [
        "whole AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        "parts AS (SELECT vec_id, label, p, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS v FROM whole, range(16) AS t(p))",
        "ranked AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole QUALIFY e < 64)",
        "book0 AS (SELECT p, e, v FROM parts JOIN ranked USING (vec_id))",
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"near{r} AS (SELECT vec_id, p, any_value(label) AS label, any_value(v) AS v, min(struct_pack(d := d, e := e)) AS best FROM "
            f"(SELECT a.vec_id, a.p, a.label, a.v, b.e, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts a JOIN book{r} b USING (p)) GROUP BY vec_id, p)"
        )
        if r < ROUNDS:
            steps.append(f"mean{r} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, best.e AS e, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS m FROM near{r}, unnest(range(1, len(v) + 1)) AS t(i) GROUP BY p, best.e, i) GROUP BY p, e)")
            steps.append(f"book{r + 1} AS (SELECT p, e, coalesce(n.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} n USING (p, e))")
    steps.append("digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)".replace("book2", f"book{ROUNDS}"))
    steps.append(f"coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"


CODES_SQL = _sql()
