"""Outliers by fences, z-scores, groups, votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import num, q
from ..functions.exprs import div, ladder, pct
from ..plans.fuse import fused, row
from ..plans.ranks import Histogram, exact_quantiles, medians


def fences(df: DataFrame, cols: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """feature, n, q25, q75, lower, upper."""
    at = exact_quantiles(df, cols, [0.25, 0.75])
    rows = []
    for c in cols:
        lo, hi = (F.lit(x).cast("double") for x in at[c])
        rows.append(row(feature=F.lit(c), n=F.count(num(c)), q25=lo, q75=hi, lower=lo - multiplier * (hi - lo), upper=hi + multiplier * (hi - lo)))
    return fused(df, rows)


def iqr_outliers(df: DataFrame, cols: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """Count and share of the values of each column outside its fences."""
    bounds = {r["feature"]: r for r in fences(df, cols, multiplier).collect()}
    rows = []
    for c in cols:
        b = bounds[c]
        out = (num(c) < F.lit(b["lower"])) | (num(c) > F.lit(b["upper"]))
        rows.append(row(feature=F.lit(c), lower=F.lit(b["lower"]).cast("double"), upper=F.lit(b["upper"]).cast("double"), n_outliers=F.count_if(out), outlier_pct=pct(F.count_if(out), F.count(num(c)))))
    return fused(df, rows)


def _centres(df: DataFrame, cols: Sequence[str], population: bool) -> dict:
    std = F.stddev_pop if population else F.stddev_samp
    return {r["feature"]: r for r in fused(df, [row(feature=F.lit(c), mean=F.avg(num(c)), std=std(num(c))) for c in cols]).collect()}


def zscore_outliers(df: DataFrame, cols: Sequence[str], threshold: float = 3.0, population: bool = True) -> DataFrame:
    at = _centres(df, cols, population)
    rows = []
    for c in cols:
        m, s = at[c]["mean"], at[c]["std"]
        z = F.abs(num(c) - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
        rows.append(row(feature=F.lit(c), n=F.count(num(c)), n_outliers=F.count_if(z > threshold), outlier_pct=pct(F.count_if(z > threshold), F.count(num(c))), max_z=F.max(z)))
    return fused(df, rows)


def modified_z_outliers(df: DataFrame, cols: Sequence[str], threshold: float = 3.5) -> DataFrame:
    """0.6745 (x - median) / MAD; a column whose MAD is 0 has none."""
    mids = medians(df, cols)
    mads = medians(df.select(*(F.abs(num(c) - F.lit(mids[c])).alias(c) for c in cols)), cols)
    rows = []
    for c in cols:
        z = F.abs(0.6745 * (num(c) - F.lit(mids[c])) / F.lit(mads[c])) if mads[c] else F.lit(0.0)
        rows.append(row(feature=F.lit(c), median_value=F.lit(mids[c]).cast("double"), mad=F.lit(mads[c]).cast("double"), n_outliers=F.count_if(z > threshold)))
    return fused(df, rows)


def flags(df: DataFrame, cols: Sequence[str], multiplier: float = 1.5, threshold: float = 3.0) -> dict[str, Column]:
    """Row flags of the two statistical methods: any column outside its fences, any |z| (sample deviation) above threshold."""
    bounds = {r["feature"]: r for r in fences(df, cols, multiplier).collect()}
    at = _centres(df, cols, population=False)
    any_of = lambda marks: F.coalesce(F.greatest(*marks, F.lit(False)), F.lit(False))
    iqr = [F.coalesce((num(c) < F.lit(bounds[c]["lower"])) | (num(c) > F.lit(bounds[c]["upper"])), F.lit(False)) for c in cols]
    z = [F.coalesce(F.abs(num(c) - F.lit(at[c]["mean"])) / F.lit(at[c]["std"]) > threshold, F.lit(False)) for c in cols if at[c]["std"]]
    return {"iqr": any_of(iqr), "zscore": any_of(z)}


def consensus(df: DataFrame, key: Sequence[str], cols: Sequence[str], share: float = 0.5, extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows with their votes; an outlier has max(1, int(methods * share)) of them or more."""
    marks = {**flags(df, cols), **(extra or {})}
    votes = sum((F.coalesce(m, F.lit(False)).cast("int") for m in marks.values()), F.lit(0))
    least = max(1, int(len(marks) * share))
    return df.select(*(q(k) for k in key), *(m.alias(f"by_{n}") for n, m in marks.items()), votes.alias("votes"), (votes >= least).alias("is_outlier"))


def by_context(df: DataFrame, cols: Sequence[str], context: str, multiplier: float = 1.5, least_rows: int = 10, least_values: int = 5) -> DataFrame:
    """Values outside the fences of their own group: feature, context, n_outliers; small groups are left out."""
    named = df.withColumn("__g", q(context))
    sizes = named.groupBy("__g").agg(F.count("*").alias("n_rows"))
    lo, hi = F.col("at")[0], F.col("at")[1]
    at = Histogram(named, cols, ["__g"]).quantiles([0.25, 0.75]).select("__g", "feature", "n", (lo - multiplier * (hi - lo)).alias("lower"), (hi + multiplier * (hi - lo)).alias("upper"))
    bounds = at.join(sizes, "__g").where((F.col("n_rows") >= least_rows) & (F.col("n") >= least_values))
    values = df.select(q(context).alias("__g"), F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), num(c).alias("__x")) for c in cols))))
    met = values.join(bounds, ["__g", "feature"])
    out = (F.col("__x") < F.col("lower")) | (F.col("__x") > F.col("upper"))
    return met.groupBy("feature", F.col("__g").cast("string").alias("context")).agg(F.first("lower").alias("lower"), F.first("upper").alias("upper"), F.count_if(out).alias("n_outliers"))


def explain(df: DataFrame, key: str, column: str, least_z: float = 2.0, k: int = 50) -> DataFrame:
    """The k rows with the largest |z| (ties: key), their percentile rank and severity."""
    at = _centres(df, [column], population=False)[column]
    z = (num(column) - F.lit(at["mean"])) / F.lit(at["std"])
    top = df.select(q(key).alias("row_key"), num(column).alias("x"), z.alias("z")).where(F.abs("z") > least_z).orderBy(F.desc(F.abs("z")), "row_key").limit(k)
    # ranks of k values only: counts of smaller values, from one scan over the histogram of values
    found = F.broadcast(top.select(F.col("x").alias("t")).distinct())
    values = df.where(num(column).isNotNull()).groupBy(num(column).alias("v")).agg(F.count("*").alias("n"))
    total = values.agg(F.sum("n").alias("total")).withColumn("one", F.lit(1))
    ranks = values.join(found, F.col("v") < F.col("t")).groupBy("t").agg(F.sum("n").alias("below"))
    severity = ladder(F.abs("z"), [(3.0, "low"), (4.0, "medium"), (5.0, "high")], "extreme")
    out = top.join(ranks, F.col("x") == F.col("t"), "left").withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    return out.select("row_key", "x", "z", (div(F.coalesce("below", F.lit(0)), F.col("total")) * 100).alias("percentile"), severity.alias("severity"))
