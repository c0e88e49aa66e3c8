"""Total orders without a single-task window.

Rows are numbered by sorted ranges and the counts of the ranges before. Windows of bounded reach then run over blocks
of consecutive rows, each block with copies of as many rows of its neighbours as the window reaches.
"""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: Consecutive rows of one window task.
BLOCK = 1 << 17


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that spark.checkpoint.dir names; a local one only where none is named and the master is local."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Has Spark's cleaner remove the files of shuffles, and of checkpoints if the session says so, that no plan refers to any more.

    The cleaner acts on what the driver's collector finds, and a driver with little to do seldom collects by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "__rn") -> DataFrame:
    """The rows with their number from 0 in the order, which should be total."""
    cols = df.columns
    at = F.shiftrightunsigned("__at", 33)
    spread = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy(at.alias("__part")).count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    placed = spread.withColumn("__part", at).join(F.broadcast(starts), "__part")
    return placed.select(*cols, (F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def blocked(df: DataFrame, before: int = 0, after: int = 0, rn: str = "__rn", block: int = BLOCK) -> tuple[DataFrame, WindowSpec]:
    """Numbered rows dealt to blocks (column __block; __own tells copies) and the window over a block.

    Functions over the window that reach at most before rows back and after rows ahead are exact on own rows.
    """
    if max(before, after) > block:
        raise ValueError("a window reaches over more than one block")
    at, place = F.expr(f"{rn} div {block}"), F.col(rn) % block
    blocks = F.array_compact(F.array(at, F.when(place >= block - before, at + 1) if before else F.lit(None).cast("long"), F.when((place < after) & (at > 0), at - 1) if after else F.lit(None).cast("long")))
    dealt = df.withColumn("__block", F.explode(blocks)).withColumn("__own", F.col("__block") == at)
    return dealt, Window.partitionBy("__block").orderBy(rn)


def bucket_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of sorted edges below the value, by a balanced tree of comparisons; bins are closed on the right."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(edges[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(edges))


def prefix_sums(df: DataFrame, order: str, sums: dict[str, Column]) -> DataFrame:
    """Rows (distinct values of order) with running totals up to and including them, summed range by range.

    There are as many sorted ranges as the session has shuffle partitions (or as adaptive execution leaves of them).
    """
    ranged = checkpointed(df.repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    offsets = totals.select("__range", *(F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums))
    within = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.select("*", *(F.sum(c).over(within).alias(f"__w_{n}") for n, c in sums.items())).join(F.broadcast(offsets), "__range")
    return out.select(*df.columns, *((F.col(f"__w_{n}") + F.col(f"__{n}")).alias(n) for n in sums))
