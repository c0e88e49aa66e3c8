"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.ordering import checkpointed

#: Rows that one sorted key range holds on average when a numbering is split into ranges.
ROWS_PER_RANGE = 4_096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    return checkpointed(df)


def unit(*parts: Column) -> Column:
    """A hash of the parts as a double in (0, 1): 52 hash bits and a half step, so the logarithm is finite."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + 0.5) / float(2**52)


def range_bits(rows: int, per_range: int = ROWS_PER_RANGE) -> int:
    """Leading hash bits that split rows into ranges of about per_range."""
    return max(0, ((rows + per_range - 1) // per_range - 1).bit_length())


def broadcast_if_small(df: DataFrame, limit: int = 500_000) -> DataFrame:
    """The rows, counted by the job that writes them: marked for broadcast up to limit rows, left to a shuffle beyond."""
    seen = Observation()
    held = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    rows = seen.get.get("rows")
    # a plan that turns out to have no rows may run without its counter
    return F.broadcast(held) if (held.count() if rows is None else rows) <= limit else held


@contextmanager
def small_batches(spark: SparkSession, rows: int = 3_000) -> Iterator[None]:
    """Arrow batches of fewer rows for the jobs that run inside; texts make large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), rows)) if int(before) > 0 else str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
