"""Exact deduplication by an extendible-hash index on shared files.

Texts are keyed by a 64-bit hash. A directory over the leading bits of the key names the bucket of an entry: it starts as
one bucket, and a bucket with more entries than its capacity is split in two by the next bit; where the bucket is as deep
as the directory, the directory doubles first. As all keys are counted beforehand, the directory is grown from the counts
of key prefixes and each entry is written once. Owner tasks take consecutive buckets each, that is ranges of keys, and
write one file for each bucket into the shared folder.

An entry stands for one text. Rows of a key that repeats are compared byte by byte: partial aggregates by key and text
combine copies in the task that reads them, so that a text held by a third of the rows leaves each task once. Texts that
differ and share a key form a chain of entries.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ordering import ensure_checkpoint_dir
from .common import broadcast_if_small, cut, table

#: Entries that a bucket holds before it is split; more where the index would have over 2^MAX_DEPTH buckets.
CAPACITY = 1 << 14
MAX_DEPTH = 13
#: Bits by which prefixes are counted beyond those that buckets of even size need.
SLACK_BITS = 3
#: A text of more than 1 / HOT of all rows is hot; there are fewer than HOT of them, and they are broadcast.
HOT = 4096


@dataclass(frozen=True)
class Directory:
    """Slots by the leading depth bits of a key, each with the number of its bucket; buckets are numbered in key order."""

    depth: int
    slots: tuple[int, ...]

    @staticmethod
    def grown(counts: dict[int, int], bits: int, capacity: int) -> Directory:
        """From the entries of each prefix of so many bits; a bucket of that depth is split no further."""
        depth, slots = 0, [(0, 0)]  # a bucket is named by its local depth and its prefix
        held = [{(0, 0): sum(counts.values())}]
        for level in range(1, bits + 1):
            held.append({})
            for prefix, n in counts.items():
                at = (level, prefix >> (bits - level))
                held[level][at] = held[level].get(at, 0) + n
        full = [(0, 0)]
        while full:
            local, prefix = full.pop()
            if local == bits or held[local].get((local, prefix), 0) <= capacity:
                continue
            if local == depth:
                depth, slots = depth + 1, [s for s in slots for _ in (0, 1)]
            width = 1 << (depth - local)
            halves = [(local + 1, 2 * prefix), (local + 1, 2 * prefix + 1)]
            slots[prefix * width : (prefix + 1) * width] = [h for h in halves for _ in range(width // 2)]
            full += halves
        order = {s: i for i, s in enumerate(dict.fromkeys(slots))}
        return Directory(depth, tuple(order[s] for s in slots))

    def bucket(self, key: Column) -> Column:
        if not self.depth:
            return F.lit(0)
        slots = F.split(F.lit(",".join(map(str, self.slots))), ",").cast("array<int>")
        return F.get(slots, F.shiftrightunsigned(key, 64 - self.depth).cast("int"))


@dataclass(frozen=True)
class Index:
    """Bucket files under path: bucket, key, chain (place among the texts of a key), keep_id, keep_row, size."""

    path: str
    directory: Directory

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("key long, chain int, keep_id long, keep_row long, size long, bucket int").parquet(self.path)


def key_of(text: Column, bits: int = 64) -> Column:
    """The leading bits of a text's hash; fewer than 64 make texts collide, for tests."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(-(1 << (64 - bits))))


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/index-{uuid.uuid4().hex}"


def _one_of(df: DataFrame, *by: str) -> DataFrame:
    """Size of each group and the row of its largest id (one of them, if rows repeat it; null ids are the smallest)."""
    return df.groupBy(*by).agg(F.count("*").alias("size"), F.max("id").alias("keep_id"), F.coalesce(F.max_by("row", "id"), F.max("row")).alias("keep_row"))


def build(rows: DataFrame, chains: DataFrame | None, directory: Directory, path: str) -> Index:
    """Writes the entries of keyed rows; chains: entries of keys whose texts differ, in place of the key's own."""
    own = _one_of(rows, "key").withColumn("chain", F.lit(0))
    if chains is not None:
        own = own.join(chains.select("key").distinct(), "key", "left_anti").unionByName(chains)
    entries = own.select("key", "chain", "keep_id", "keep_row", "size", directory.bucket(F.col("key")).alias("bucket"))
    owners = entries.repartitionByRange("bucket").sortWithinPartitions("bucket", "key", "chain")
    owners.write.partitionBy("bucket").parquet(path)
    return Index(path, directory)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, capacity: int = CAPACITY) -> DataFrame:
    """Of rows with byte for byte equal texts, the one with the largest id stays: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    One row a document. A null text counts as empty; a null id is smaller than all others; of rows that share the largest
    id of their group, one has kept true. Ids are whole numbers. An empty table gives no rows. Only the named columns are
    read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), key_of(text, key_bits).alias("key"), text.alias("text"))
    rows = cut(keyed.select("id", "key", F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("row")))
    keys = cut(rows.groupBy("key").agg(F.count("*").alias("n")))
    n_keys, n_rows = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    capacity = max(capacity, n_keys >> MAX_DEPTH)
    bits = ((n_keys // capacity).bit_length() + SLACK_BITS) if n_keys > capacity else 0
    prefix = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    directory = Directory.grown(dict(keys.groupBy(prefix.alias("p")).count().collect()), bits, capacity)

    # bytes of repeated keys are compared: one row for each distinct text, copies combined where they are read
    repeated = broadcast_if_small(keys.where("n > 1").select("key"))
    texts = keyed.select("key", "text").join(repeated, "key", "left_semi").groupBy("key", "text").agg(F.count("*").alias("n"))
    split = cut(texts.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key"))
    collide = not split.isEmpty()
    chained = None
    if collide:
        again = cut(keyed.join(split, "key", "left_semi").withColumns({"row": F.monotonically_increasing_id(), "sha": F.sha2("text", 256)}))
        chained = cut(_one_of(again, "key", "text").withColumn("chain", F.row_number().over(Window.partitionBy("key").orderBy("text")) - 1))
    index = build(rows, chained.drop("text") if collide else None, directory, shared_folder(spark))

    entries = index.entries(spark)
    plain = rows
    if collide:
        plain = rows.join(split, "key", "left_anti")
        entries = entries.join(split, "key", "left_anti")
    hot = F.broadcast(entries.where(F.col("size") * HOT > n_rows).select("key", *(F.col(c).alias(f"hot_{c}") for c in ("keep_id", "keep_row", "size", "bucket"))))
    spread = plain.join(hot, "key", "left").withColumn("at", F.when(F.col("hot_size").isNull(), F.col("key")).otherwise(F.xxhash64("row")))
    rest = entries.where(F.col("size") * HOT <= n_rows).select(F.col("key").alias("at"), "keep_id", "keep_row", "size", "bucket", F.lit(True).alias("cool"))
    met = spread.join(rest, (spread["at"] == rest["at"]) & F.col("hot_size").isNull(), "left")
    of = lambda c: F.when(F.col("hot_size").isNull(), F.col(c)).otherwise(F.col(f"hot_{c}"))
    out = met.select(F.col("id").alias("doc_id"), of("keep_id").alias("keep_id"), of("size").alias("group_size"), (F.col("row") == of("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"), of("bucket").alias("bucket"))
    if collide:
        more = again.join(chained.drop("chain"), ["key", "text"])
        out = out.unionByName(more.select(F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"), directory.bucket(F.col("key")).alias("bucket")))
    return out


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("bucket")


#: The same in DuckDB.
EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
