"""Class imbalance, group rates, distances between groups, proxies and intersections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import num, q
from ..functions.exprs import corr, div, ladder
from ..plans.fuse import fused, row
from ..plans.ranks import medians


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    counts = df.where(q(target).isNotNull()).groupBy(q(target)).agg(F.count("*").alias("n"))
    got = counts.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.sum("n").alias("n"), F.count("*").alias("n_classes"))
    ratio = div(F.col("most"), F.col("least"))
    return got.select("n", "n_classes", div(F.col("most") - F.col("least"), F.col("n")).alias("imbalance"), ratio.alias("ratio"), ladder(ratio, [(2.0, "none"), (5.0, "low"), (10.0, "medium"), (50.0, "high")], "critical").alias("severity"))


def group_rates(df: DataFrame, group: str, target: str, positive: str | None = None) -> DataFrame:
    """Count, share and positive rate of each group; without a positive class it is the share of the group's own mode."""
    cells = df.where(q(group).isNotNull() & q(target).isNotNull()).groupBy(q(group).cast("string").alias("group"), q(target).cast("string").alias("class")).agg(F.count("*").alias("n"))
    hit = F.max("n") if positive is None else F.sum(F.when(F.col("class") == positive, F.col("n")).otherwise(0))
    per = cells.groupBy("group").agg(F.sum("n").alias("n"), hit.alias("hit"))
    return per.select("group", "n", div(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("share"), div(F.col("hit"), F.col("n")).alias("positive_rate"))


def parity(rates: DataFrame) -> DataFrame:
    """Largest difference of positive rates and disparate impact (least over most)."""
    got = rates.agg(F.max("positive_rate").alias("hi"), F.min("positive_rate").alias("lo"), F.count("*").alias("n_groups"))
    return got.select("n_groups", (F.col("hi") - F.col("lo")).alias("max_difference"), div(F.col("lo"), F.col("hi")).alias("disparate_impact"), (F.col("hi") - F.col("lo") > 0.1).alias("biased"))


def group_distances(df: DataFrame, group: str, target: str) -> DataFrame:
    """KL divergence and Jensen-Shannon distance of the target between the first two groups by name; absent classes count 1e-10."""
    cells = df.where(q(group).isNotNull() & q(target).isNotNull()).groupBy(q(group).cast("string").alias("g"), q(target).cast("string").alias("t")).agg(F.count("*").cast("double").alias("n"))
    names = [r["g"] for r in cells.select("g").distinct().orderBy("g").limit(2).collect()]
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "group_1 string, group_2 string, kl double, js double")
    one, two = names
    side = lambda g: F.sum(F.when(F.col("g") == g, F.col("n")).otherwise(0.0))
    both = cells.where(F.col("g").isin(names)).groupBy("t").agg(side(one).alias("a"), side(two).alias("b"))
    every = Window.partitionBy()
    p0, q0 = F.col("a") / F.sum("a").over(every), F.col("b") / F.sum("b").over(every)
    raw = both.select(F.when(p0 > 0, p0).otherwise(1e-10).alias("p"), F.when(q0 > 0, q0).otherwise(1e-10).alias("c"))
    norm = raw.select((F.col("p") / F.sum("p").over(every)).alias("p"), (F.col("c") / F.sum("c").over(every)).alias("c"))
    m = (F.col("p") + F.col("c")) / 2
    js = F.sqrt(F.greatest(F.sum(F.col("p") * F.ln(F.col("p") / m) + F.col("c") * F.ln(F.col("c") / m)) / 2, F.lit(0.0)))
    return norm.agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("c"))).alias("kl"), js.alias("js")).select(F.lit(one).alias("group_1"), F.lit(two).alias("group_2"), "kl", "js")


def proxies(df: DataFrame, cols: Sequence[str], protected: str, threshold: float = 0.5) -> DataFrame:
    """Correlation of each feature (gaps filled by the median) with the rank of the protected value."""
    values = df.select(q(protected).cast("string").alias("__p")).where("__p is not null").distinct()
    ranks = values.select("__p", (F.row_number().over(Window.orderBy("__p")) - 1).cast("double").alias("__code"))
    mids = medians(df, cols)
    coded = df.withColumn("__p", q(protected).cast("string")).join(F.broadcast(ranks), "__p", "left")
    got = fused(coded, [row(feature=F.lit(c), n=F.count("__code"), r=corr(F.coalesce(num(c), F.lit(mids[c]).cast("double")), F.col("__code"))) for c in cols])
    return got.withColumn("is_proxy", F.coalesce(F.abs("r") > threshold, F.lit(False)))


def intersections(df: DataFrame, a: str, b: str, target: str, least: int = 10) -> DataFrame:
    """Positive rates (own mode) of the pairs of two protected attributes with enough rows."""
    named = df.withColumn("__ab", F.concat_ws("_", q(a).cast("string"), q(b).cast("string"))).where(q(a).isNotNull() & q(b).isNotNull())
    return group_rates(named, "__ab", target).where(F.col("n") >= least).select("group", "n", "positive_rate")


def risk(imbalanced: bool, biased: bool, proxied: bool) -> str:
    points = imbalanced + 2 * biased + proxied
    return "high" if points >= 3 else "medium" if points >= 2 else "low"
