"""Connected components of a distributed edge list, by alternating large and small stars.

Each step sends every node's neighbours to the smallest node it knows, with joins and minimum aggregates only: no list
of a node's neighbours is ever built, and a chain of any length settles in a number of rounds that grows with its
logarithm. Edges are written to the shared checkpoint folder after each round. The rounds end when every node has one
edge, to a smaller node that has none to a smaller one itself; that takes one count by node and no round without a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import checkpointed


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every larger node has one edge and is no other node's smaller one, which no further round changes."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    at = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return at.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).count() == 0


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """The root (smallest node) of each node that has an edge: node, root.

    edges: two columns of longs. Repeated edges, edges in both directions and loops are fine; no edges give no rows.
    Raises if the rounds do not settle.
    """
    a, b = edges.columns
    now = checkpointed(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if _settled(now):
            break
        now = checkpointed(_small(_large(now)))
    else:
        if not _settled(now):
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
