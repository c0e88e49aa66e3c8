"""Profiles of columns: moments, quantiles, frequent values, classes, constants, correlations, normality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import CATEGORICAL, NUMERIC, classify, columns_of, kind_of, num, q
from ..functions.exprs import corr, div, kurtosis, ladder, skew
from ..plans.fuse import fused, long_values, row
from ..plans.ranks import Histogram


def moments(c: Column) -> dict[str, Column]:
    """The numeric statistics of a column but its quantiles, as aggregates of one scan."""
    return {
        "n": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "var": F.var_samp(c), "min_value": F.min(c), "max_value": F.max(c),
        "skew": skew(c), "kurtosis": kurtosis(c), "value_range": F.max(c) - F.min(c),
        "cv": F.when(F.avg(c) == 0, F.lit(float("inf"))).otherwise(div(F.stddev_samp(c), F.avg(c))),
    }


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row a numeric column (and group of by) with its moments; columns without values are left out."""
    cols = list(cols or columns_of(df, NUMERIC, but=tuple(by)))
    sums = fused(df, [row(feature=F.lit(c), **moments(num(c))) for c in cols], by, per_scan=16).where("n > 0")
    at = Histogram(df, cols, by).quantiles([0.25, 0.5, 0.75]).select(*(q(b).alias(f"__k{i}") for i, b in enumerate([*by, "feature"])), "at")
    same = reduce(lambda a, b: a & b, (q(b).eqNullSafe(F.col(f"__k{i}")) for i, b in enumerate([*by, "feature"])))
    return sums.join(at, same).select(
        *map(q, by), "feature", "n", "mean", F.col("at")[1].alias("median"), "std", "var", "min_value", "max_value", F.col("at")[0].alias("q25"), F.col("at")[2].alias("q75"),
        "skew", "kurtosis", "value_range", (F.col("at")[2] - F.col("at")[0]).alias("iqr"), "cv",
    )


def skew_interpretation(summary: DataFrame) -> DataFrame:
    size = F.abs("skew")
    shape = ladder(size, [(0.5, "approximately symmetric"), (1.0, "moderately skewed")], "highly skewed")
    side = F.when(size < 0.5, "none").when(F.col("skew") > 0, "right").otherwise("left")
    return summary.select("feature", "skew", shape.alias("interpretation"), side.alias("tail"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature, value, n for the non-null values of several columns, from one scan."""
    return long_values(df, cols).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("n"))


def categorical_summary(df: DataFrame, cols: Sequence[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Distinct values, the most and least frequent one (ties: smallest value), and what the cardinality says."""
    counts = counts if counts is not None else value_counts(df, list(cols or columns_of(df, CATEGORICAL)))
    out = counts.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_unique"),
        F.min(F.struct((-F.col("n")).alias("r"), "value")).alias("top"), F.min(F.struct(F.col("n").alias("r"), "value")).alias("low"),
    )
    ratio = div(F.col("n_unique"), F.col("n"))
    return out.select(
        "feature", "n", "n_unique", F.col("top.value").alias("most_frequent"), (-F.col("top.r")).alias("most_count"), F.col("low.value").alias("least_frequent"),
        F.col("low.r").alias("least_count"), ratio.alias("cardinality_ratio"), ladder(ratio, [(0.5, "low"), (0.9, "high")], "identifier", strict=False).alias("cardinality"),
    )


def top_values(counts: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """One row a class: count, share, and the table's majority ratio with its severity."""
    counts = df.where(q(target).isNotNull()).groupBy(q(target).cast("string").alias("class")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    ratio = div(F.max("n").over(every), F.min("n").over(every))
    return counts.select("class", "n", div(F.col("n"), F.sum("n").over(every)).alias("share"), ratio.alias("imbalance_ratio")).withColumn(
        "balance", ladder(F.col("imbalance_ratio"), [(1.5, "Balanced"), (4.0, "Slightly Imbalanced"), (10.0, "Moderately Imbalanced")], "Highly Imbalanced")
    )


def variances(df: DataFrame, cols: Sequence[str], low: float = 0.01) -> DataFrame:
    return fused(df, [row(feature=F.lit(c), variance=F.var_samp(num(c)), is_low=F.coalesce(F.var_samp(num(c)) < low, F.lit(False))) for c in cols])


def cardinalities(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values a column; the exact count goes over (column, value) pairs, so no task holds a set."""
    total = fused(df, [row(feature=F.lit(c), n_rows=F.count("*"), n_distinct=F.approx_count_distinct(q(c)).cast("long")) for c in cols])
    if approximate:
        out = total
    else:
        exact = value_counts(df, cols).groupBy("feature").agg(F.count("*").alias("n_distinct"))
        out = total.drop("n_distinct").join(exact, "feature", "left").fillna(0, ["n_distinct"])
    text = [c for c in cols if kind_of(df.schema[c]) == CATEGORICAL]
    ratio = div(F.col("n_distinct"), F.col("n_rows"))
    flag = F.when(~F.col("feature").isin(text or [""]), "none").when(ratio > 0.8, "id_like").when(F.col("n_distinct") > 100, "high").otherwise("none")
    return out.select("feature", "n_rows", "n_distinct", ratio.alias("ratio"), flag.alias("cardinality_issue"))


def constants(df: DataFrame, cols: Sequence[str], quasi: float = 0.95) -> DataFrame:
    """Constant and quasi-constant columns; the share of the top value is of all rows, missing ones too."""
    counts = value_counts(df, cols).groupBy("feature").agg(F.count("*").alias("n_unique"), F.max("n").alias("top_count"))
    total = fused(df, [row(feature=F.lit(c), n_rows=F.count("*")) for c in cols])
    both = total.join(counts, "feature", "left").fillna(0, ["n_unique", "top_count"])
    share = div(F.col("top_count"), F.col("n_rows"))
    return both.select(
        "feature", "n_rows", "n_unique", share.alias("top_share"),
        F.when(F.col("n_unique") <= 1, "constant").when(share >= quasi, "quasi_constant").when(div(F.col("n_unique"), F.col("n_rows")) < 0.01, "low_uniqueness").otherwise("none").alias("flag"),
    )


def correlations(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.0, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Pearson correlations of column pairs over rows where both are present: feature_1, feature_2, r; null r is left out."""
    pairs = list(pairs if pairs is not None else combinations(cols or columns_of(df, NUMERIC), 2))
    got = fused(df, [row(feature_1=F.lit(a), feature_2=F.lit(b), r=corr(num(a), num(b))) for a, b in pairs])
    return got.where(F.col("r").isNotNull() & (F.abs("r") >= threshold))


def correlation_groups(pairs: DataFrame, cols: Sequence[str]) -> list[list[str]]:
    """Greedy groups of correlated columns in column order, from thresholded pairs."""
    near: dict[str, set[str]] = {c: set() for c in cols}
    for r in pairs.select("feature_1", "feature_2").collect():
        near[r["feature_1"]].add(r["feature_2"])
        near[r["feature_2"]].add(r["feature_1"])
    seen: set[str] = set()
    groups = []
    for c in cols:
        if c not in seen and near[c] - seen:
            group = [c, *(x for x in cols if x in near[c] and x not in seen)]
            seen.update(group)
            groups.append(group)
    return groups


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(q(a).isNotNull() & q(b).isNotNull()).groupBy(q(a).cast("string").alias("a"), q(b).cast("string").alias("b")).agg(F.count("*").alias("n"))


def chi_square(table: DataFrame) -> DataFrame:
    """Statistic and degrees of freedom of a contingency table (a, b, n); Yates' correction for one degree.

    Works on the marginals: with E = row * column / total, the cells that do not occur add up to the total less the
    expected counts of those that do.
    """
    of_a, of_b = table.groupBy("a").agg(F.sum("n").alias("na")), table.groupBy("b").agg(F.sum("n").alias("nb"))
    size = table.agg(F.sum("n").cast("double").alias("total"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb")).withColumn("one", F.lit(1))
    cells = table.join(of_a, "a").join(of_b, "b").withColumn("one", F.lit(1)).join(F.broadcast(size), "one")
    expected = F.col("na") * F.col("nb") / F.col("total")
    gap = F.when((F.col("ka") == 2) & (F.col("kb") == 2), F.greatest(F.abs(F.col("n") - expected) - F.least(F.lit(0.5), F.abs(F.col("n") - expected)), F.lit(0.0))).otherwise(F.col("n") - expected)
    got = cells.select("total", "ka", "kb", expected.alias("e"), (gap * gap / expected).alias("part"))
    per = got.agg(F.sum("part").alias("part"), F.sum("e").alias("e"), F.first("total").alias("total"), F.first("ka").alias("ka"), F.first("kb").alias("kb"))
    return per.select((F.col("part") + (F.col("total") - F.col("e"))).alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).cast("long").alias("dof"), F.col("total").cast("long").alias("n"))


def normality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Jarque-Bera statistic and its p-value (two degrees of freedom, so exp(-x/2))."""
    rows = []
    for c in cols:
        g1, g2 = F.skewness(num(c)), F.kurtosis(num(c))
        jb = F.count(num(c)) / 6.0 * (g1 * g1 + g2 * g2 / 4)
        rows.append(row(feature=F.lit(c), n=F.count(num(c)), jarque_bera=jb, p_value=F.exp(-jb / 2)))
    return fused(df, rows)


def type_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Kind of each column, with texts told from categories by average length and uniqueness."""
    kinds = {c: kind_of(df.schema[c]) for c in cols}
    lengths = fused(df, [row(feature=F.lit(c), kind=F.lit(kinds[c]), n=F.count(q(c)), avg_length=F.avg(F.length(q(c).cast("string")))) for c in cols])
    unique = value_counts(df, cols).groupBy("feature").agg(F.count("*").alias("n_unique"))
    both = lengths.join(unique, "feature", "left").fillna(0, ["n_unique"])
    ratio = div(F.col("n_unique"), F.col("n"))
    text = (F.col("kind") == CATEGORICAL) & ((F.col("avg_length") > 50) | (ratio > 0.8))
    return both.select("feature", F.when(text, "text").otherwise(F.col("kind")).alias("feature_type"), "n_unique", ratio.alias("unique_ratio"), F.when(F.col("kind") == CATEGORICAL, F.col("avg_length")).alias("avg_length"))


def type_consistency(df: DataFrame, cols: Sequence[str], tolerance: float = 0.1) -> DataFrame:
    """Strings that are numbers or dates, doubles that are whole."""
    rows = []
    for c in cols:
        kind = kind_of(df.schema[c])
        n = F.count(q(c))
        s = q(c).cast("string")
        lost = lambda x, s=s, n=n: div(F.count_if(s.isNotNull() & x.isNull()), n)
        floating = df.schema[c].dataType.typeName() in ("double", "float")
        rows.append(row(
            feature=F.lit(c), stored=F.lit(kind), n=n,
            numeric_loss=lost(s.try_cast("double")) if kind == CATEGORICAL else F.lit(None).cast("double"),
            date_loss=lost(s.try_cast("date")) if kind == CATEGORICAL else F.lit(None).cast("double"),
            whole=F.coalesce(F.bool_and(num(c) % 1 == 0), F.lit(False)) if floating else F.lit(False),
        ))
    issue = F.when(F.col("n") == 0, "none").when(F.col("numeric_loss") < tolerance, "numeric_as_text").when(F.col("date_loss") < tolerance, "datetime_as_text").when(F.col("whole"), "integer_as_float").otherwise("none")
    return fused(df, rows).withColumn("type_issue", issue)


def id_columns(df: DataFrame, cols: Sequence[str], ratio: float = 0.9) -> DataFrame:
    """Columns that look like identifiers: unique, named so, of one length, or UUIDs; plain doubles never are."""
    uuid = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    cols = [c for c in cols if df.schema[c].dataType.typeName() not in ("double", "float")]
    rows = []
    for c in cols:
        s = q(c).cast("string")
        named = any(c.lower() == w or c.lower().endswith("_" + w) or c.lower().startswith(w + "_") for w in ("id", "key", "uuid", "guid")) or c.lower().endswith("key")
        rows.append(row(feature=F.lit(c), n=F.count(s), named=F.lit(named), fixed=F.coalesce((F.min(F.length(s)) == F.max(F.length(s))) & (F.min(F.length(s)) >= 8), F.lit(False)), uuid_share=F.coalesce(div(F.count_if(s.rlike(uuid)), F.count(s)), F.lit(0.0))))
    unique = value_counts(df, cols).groupBy("feature").agg(F.count("*").alias("n_unique"))
    both = fused(df, rows).join(unique, "feature", "left").fillna(0, ["n_unique"])
    share = F.coalesce(div(F.col("n_unique"), F.col("n")), F.lit(0.0))
    return both.select("feature", share.alias("unique_ratio"), "named", "fixed", "uuid_share", ((share >= ratio) | (F.col("uuid_share") > 0.5) | (F.col("named") & (share > 0.5)) | (F.col("fixed") & (share > 0.5))).alias("id_like"))


def validate(df: DataFrame) -> DataFrame:
    """Shape, duplicate rows (every repeat after the first) and missing values of a table, as metric rows."""
    cols = df.columns
    whole = df.groupBy(*(q(c) for c in cols)).agg(F.count("*").alias("__n")).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), (F.coalesce(F.sum("__n"), F.lit(0)) - F.count("*")).alias("duplicates"))
    missing = fused(df, [row(metric=F.lit(f"missing:{c}"), value=F.count_if(q(c).isNull()).cast("long")) for c in cols])
    empty = fused(df, [row(metric=F.lit(f"all_null:{c}"), value=(F.count(q(c)) == 0).cast("long")) for c in cols])
    shape = whole.select(F.inline(F.array(row(metric=F.lit("rows"), value=F.col("rows").cast("long")), row(metric=F.lit("columns"), value=F.lit(len(cols)).cast("long")), row(metric=F.lit("duplicate_rows"), value=F.col("duplicates").cast("long")))))
    return shape.unionByName(missing).unionByName(empty)


def advise(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Recommendations: missing >= 20 % critical, else important; |skew| > 1; |r| >= 0.95; identifiers."""
    kinds = classify(df.drop(*skip))
    nums, cats = kinds[NUMERIC], kinds[CATEGORICAL]
    share = fused(df, [row(feature=F.lit(c), x=div(F.count_if(q(c).isNull()), F.count("*"))) for c in nums + cats])
    lacking = share.where("x > 0").select("feature", F.lit("missing").alias("advice"), F.when(F.col("x") >= 0.2, "critical").otherwise("important").alias("level"))
    skewed = fused(df, [row(feature=F.lit(c), x=skew(num(c)), n=F.count(num(c))) for c in nums]).where("n >= 10 and abs(x) > 1").select("feature", F.lit("skewed").alias("advice"), F.lit("moderate").alias("level"))
    doubled = correlations(df, nums, 0.95).select(F.concat_ws("~", "feature_1", "feature_2").alias("feature"), F.lit("correlated").alias("advice"), F.lit("important").alias("level"))
    unique = cardinalities(df, nums + cats).where("ratio > 0.9").select("feature", F.lit("identifier").alias("advice"), F.lit("moderate").alias("level"))
    return lacking.unionByName(skewed).unionByName(doubled).unionByName(unique)


