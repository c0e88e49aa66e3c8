"""Samples: all seeded, all reproducible, none by collecting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import q
from ..plans.ordering import numbered


def draw(keys: Sequence[str], seed: int) -> Column:
    """A hash of a row's key as hexadecimal digits, the same in any engine with md5."""
    return F.md5(F.concat_ws("#", *(q(k).cast("string") for k in keys), F.lit(str(seed))))


def random_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are fewer): those with the smallest draws."""
    return df.orderBy(draw(keys, seed), *(q(k) for k in keys)).limit(n)


def random_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def stratified(df: DataFrame, stratum: str, keys: Sequence[str], fraction: float = 0.1, seed: int = 42, ranges: int = 64) -> DataFrame:
    """max(1, int(rows * fraction)) rows of each stratum, those with the smallest draws.

    Draws are cut into ranges, whose counts tell which range holds a stratum's last taken row; only within a range are
    rows ranked, so a large stratum is ranked by many tasks.
    """
    s, r = F.col("__s"), F.col("__r")
    held = df.withColumns({"__s": q(stratum), "__d": draw(keys, seed)}).withColumn("__r", (F.conv(F.substring("__d", 1, 4), 16, 10).cast("long") * ranges / 65536).cast("int"))
    counts = held.groupBy("__s", "__r").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("__s").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    plan = counts.select(s.alias("__s2"), r.alias("__r2"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("__before"), F.greatest(F.lit(1), F.floor(F.sum("c").over(Window.partitionBy("__s")) * fraction)).alias("__take"))
    plan = plan.where("__before < __take")
    met = held.join(F.broadcast(plan) if plan.count() <= 500_000 else plan, s.eqNullSafe(F.col("__s2")) & (r == F.col("__r2")))
    w = Window.partitionBy("__s", "__r").orderBy("__d", *(q(k) for k in keys))
    return met.withColumn("__k", F.row_number().over(w) + F.col("__before")).where("__k <= __take").select(*(q(c) for c in df.columns))


def systematic(df: DataFrame, order: Sequence[str], step: int = 10, start: int = 0) -> DataFrame:
    return numbered(df, [q(c) for c in order]).where((F.col("__rn") - start) % step == 0).drop("__rn")


def clusters(df: DataFrame, column: str, n: int = 10, seed: int = 42) -> DataFrame:
    """All rows of the n clusters with the smallest draws."""
    chosen = df.select(q(column).alias("__c")).where("__c is not null").distinct().orderBy(F.md5(F.concat_ws("#", F.col("__c").cast("string"), F.lit(str(seed)))), "__c").limit(n)
    return df.join(F.broadcast(chosen), q(column) == F.col("__c"), "left_semi")


def weighted(df: DataFrame, keys: Sequence[str], weight: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, in proportion to weight: the smallest of -ln(u) / weight; rows without weight never come."""
    u = (F.conv(F.substring(draw(keys, seed), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)
    key = -F.log(u) / q(weight).cast("double")
    return df.where(q(weight) > 0).withColumn("__k", key).orderBy("__k", *(q(k) for k in keys)).limit(n).drop("__k")
