"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through region and rack to a shard. At each level every child draws ``ln(u) / weight``
with u a hash of the row's key and the child's name, and the largest draw wins, so a child wins in proportion to its
weight, and a change of one child's weight moves rows only into or out of that child's subtree. The draws depend on
nothing but key and tree: no shuffle is needed to place rows. A new shard opens a region of its own (:func:`grow`):
then no weight of an older subtree changes and rows move only into the new shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROWS_PER_RANGE, cut, range_bits, table, unit

#: (region, rack, shard, weight)
Leaf = tuple[str, str, int, float]
N_SHARDS = 16


def default_tree(n_shards: int = N_SHARDS, racks: int = 2, shards_per_rack: int = 4) -> list[Leaf]:
    """Shards 0 to n_shards - 1 of weight 1, dealt to racks and regions in order."""
    return [(f"region{s // (racks * shards_per_rack)}", f"rack{s // shards_per_rack}", s, 1.0) for s in range(n_shards)]


def grow(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    new = max(leaf[2] for leaf in tree) + 1
    return [*tree, (f"region+{new}", f"rack+{new}", new, weight)]


def _winner(key: Column, level: str, children: list[tuple[str, float, Column]]) -> Column:
    """The result of the child with the largest draw."""
    if len(children) == 1:
        return children[0][2]
    draws = [F.log(unit(key, F.lit(f"{level}/{name}"))) / F.lit(float(weight)) for name, weight, _ in children]
    best = F.array_position(F.array(*draws), F.greatest(*draws))
    out = children[-1][2]
    for at, (_, _, result) in reversed(list(enumerate(children[:-1], 1))):
        out = F.when(best == at, result).otherwise(out)
    return out


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard of a key: the best region, in it the best rack, in it the best shard. Weights must be positive."""
    if any(leaf[3] <= 0 for leaf in tree):
        raise ValueError("weights must be positive; leave a drained shard out of the tree")
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in tree:
        regions.setdefault(leaf[0], {}).setdefault(leaf[1], []).append(leaf)
    weigh = lambda leaves: sum(leaf[3] for leaf in leaves)
    of_region = []
    for region, racks in regions.items():
        of_rack = [(rack, weigh(leaves), _winner(key, f"{region}/{rack}", [(str(s), w, F.lit(s)) for _, _, s, w in leaves])) for rack, leaves in racks.items()]
        of_region.append((region, sum(weigh(leaves) for leaves in racks.values()), _winner(key, region, of_rack)))
    return _winner(key, "root", of_region)


def shard(docs: DataFrame, tree: Sequence[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Shard and slot of each document, and its shard when one more shard opens.

    Returns one row a document: doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot, grown_shard. A null text
    has no bytes (size 1, checksum 0); a null id is placed like the word null; rows that repeat an id share its shard
    and take slots of their own; an empty table gives an empty result. Slots count the rows of a shard from 0 in the
    order of a hash of the id: the hash space is cut into ranges that are sorted apart, and a range begins where the
    counts of those before it end.
    """
    tree = list(tree or default_tree())
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = cut(docs.select(
        F.col(id_col).alias("__id"), (F.octet_length(text) + 1).cast("long").alias("__size"), F.crc32(text).alias("__crc"),
        shard_of(key, tree).cast("int").alias("__shard"), shard_of(key, grow(tree)).cast("int").alias("__grown"), F.xxhash64(key, F.lit("slot")).alias("__key"),
    ))
    bits = range_bits(placed.count() // len(tree), rows_per_range)
    at = F.shiftrightunsigned("__key", 64 - bits) if bits else F.lit(0).cast("long")
    ranged = placed.withColumn("__range", at)
    counts = ranged.groupBy("__shard", "__range").count()
    earlier = Window.partitionBy("__shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__shard", "__range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__shard", "__range").orderBy("__key", "__id", "__crc", "__size")
    return (
        ranged.withColumn("__place", F.row_number().over(within) - 1)
        .join(offsets, ["__shard", "__range"])
        .select(
            F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.col("__shard").alias("shard"),
            (F.col("__offset") + F.col("__place")).cast("long").alias("slot"), F.col("__grown").alias("grown_shard"),
        )
    )


def op7_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
