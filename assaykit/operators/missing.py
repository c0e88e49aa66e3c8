"""Completeness and missingness."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import num, q
from ..functions.distributions import chi2_sf, t_two_sided
from ..functions.exprs import corr, div, ladder, pct, skew
from ..plans.fuse import fused, row
from ..plans.ranks import Histogram
from .profile import chi_square


def by_column(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """feature, n_rows, n_missing, missing_pct, high (50 % or more)."""
    rows = [row(feature=F.lit(c), n_rows=F.count("*"), n_missing=F.count_if(q(c).isNull()), missing_pct=pct(F.count_if(q(c).isNull()), F.count("*"))) for c in cols or df.columns]
    return fused(df, rows).withColumn("high", F.col("missing_pct") >= 50)


def indicators(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*(q(c).isNull().cast("int").alias(c) for c in cols))


def patterns(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10, only_missing: bool = False) -> DataFrame:
    """The k most frequent patterns, as a string of a 0 or 1 a column (ties: pattern); all rows count."""
    cols = list(cols or df.columns)
    bits = F.concat(*(q(c).isNull().cast("int").cast("string") for c in cols))
    counts = df.groupBy(bits.alias("pattern")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("n_rows")).withColumn("one", F.lit(1))
    shown = counts.where(F.col("pattern").contains("1")) if only_missing else counts
    top = shown.orderBy(F.desc("n"), "pattern").limit(k)
    return top.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("pattern", "n", pct(F.col("n"), F.col("n_rows")).alias("share_pct"))


def indicator_correlations(df: DataFrame, cols: Sequence[str], threshold: float = 0.5) -> DataFrame:
    marks = indicators(df, cols)
    got = fused(marks, [row(feature_1=F.lit(a), feature_2=F.lit(b), r=corr(num(a), num(b))) for a, b in combinations(cols, 2)])
    return got.where(F.abs("r") > threshold)


def per_row(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    count = sum((q(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.select(count.alias("m")).agg(
        F.count_if(F.col("m") > 0).alias("rows_any"), F.count_if(F.col("m") == len(cols)).alias("rows_all"),
        F.coalesce(F.max("m"), F.lit(0)).cast("long").alias("max_missing"), F.avg("m").alias("avg_missing"),
    )


def target_cross(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Missing values of each feature where the target is missing and where it is not."""
    t = q(target).isNull()
    return fused(df, [row(feature=F.lit(c), n_target_missing=F.count_if(t), n_both=F.count_if(t & q(c).isNull()), pct_given_target_missing=pct(F.count_if(t & q(c).isNull()), F.count_if(t))) for c in cols])


def score(df: DataFrame, target: str | None = None) -> DataFrame:
    """Completeness score: 100 less the missing share, wide gaps and a gappy target, plus 5 if few columns have gaps."""
    per = by_column(df)
    t = F.coalesce(F.max(F.when(F.col("feature") == (target or ""), F.col("missing_pct"))), F.lit(0.0))
    k = F.count("*").cast("double")
    got = per.agg(
        pct(F.sum("n_missing"), F.sum("n_rows")).alias("overall"), (F.count_if("high") / k).alias("high"), F.least(t / 2, F.lit(20.0)).alias("target"), (F.count_if(F.col("n_missing") > 0) / k).alias("gaps")
    )
    raw = 100 - F.col("overall") - 30 * F.col("high") - F.col("target") + F.when(F.col("gaps") < 0.1, 5.0).otherwise(0.0)
    return got.select(F.col("overall").alias("overall_missing_pct"), F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 2).alias("score"))


def recommendations(per_column: DataFrame) -> DataFrame:
    """What to do about each column with gaps."""
    share = F.col("missing_pct")
    what = ladder(share, [(5.0, "mean or mode"), (20.0, "nearest neighbours"), (50.0, "model-based")], "drop the column", strict=False)
    return per_column.where("n_missing > 0").select("feature", "missing_pct", what.alias("recommendation"))


def imputation_impact(df: DataFrame, cols: Sequence[str], methods: Sequence[str] = ("mean", "median", "mode")) -> DataFrame:
    """Mean, deviation, median and skew of each column before and after filling its gaps.

    Medians and modes come from one histogram of the columns, those of filled columns too.
    """
    seen = Histogram(df, cols)
    mid = {r["feature"]: r["at"][0] for r in seen.quantiles([0.5]).collect()}
    mode = {r["feature"]: r["mode"] for r in seen.modes().collect()}
    of = {r["feature"]: r for r in fused(df, [row(feature=F.lit(c), mean=F.avg(num(c)), gaps=F.count_if(num(c).isNull())) for c in cols]).collect()}
    fill = {c: {"mean": of[c]["mean"], "median": mid.get(c), "mode": mode.get(c)} for c in cols}
    after = seen.filled_medians({c: {m: fill[c][m] for m in methods} for c in cols}, {c: of[c]["gaps"] for c in cols})
    rows = []
    for c in cols:
        for m in methods:
            value = fill[c][m]
            x = F.coalesce(num(c), F.lit(value).cast("double"))
            rows.append(row(feature=F.lit(c), method=F.lit(m), fill=F.lit(value).cast("double"), mean_delta=F.avg(x) - F.avg(num(c)), std_delta=F.stddev_samp(x) - F.stddev_samp(num(c)), median_delta=F.lit(after[c, m] - mid[c] if (c, m) in after else None).cast("double"), skew_delta=skew(x) - skew(num(c))))
    return fused(df, rows)


def ttest_stats(df: DataFrame, column: str, others: Sequence[str]) -> DataFrame:
    """Pooled t statistic of each other column between rows where the column is missing and where it is present."""
    gone = q(column).isNull()
    rows = []
    for c in others:
        a, b = F.when(gone, num(c)), F.when(~gone, num(c))
        n, m = F.count(a), F.count(b)
        pooled = div((n - 1) * F.var_samp(a) + (m - 1) * F.var_samp(b), n + m - 2)
        rows.append(row(feature=F.lit(c), n_missing=n, n_present=m, t_stat=div(F.avg(a) - F.avg(b), F.sqrt(pooled * (div(F.lit(1.0), n) + div(F.lit(1.0), m))))))
    return fused(df, rows).where("n_missing > 5 and n_present > 5")


def equal_width(df: DataFrame, column: str, bins: int) -> tuple[float, float] | None:
    r = df.agg(F.min(num(column)), F.max(num(column))).first()
    return None if r[0] is None else (float(r[0]), float(r[1]))


def bin_of(x, lo: float, hi: float, bins: int):
    """Equal-width bin from 0; the maximum falls into the last."""
    if hi <= lo:
        return F.lit(0)
    return F.least(F.floor((x - lo) / ((hi - lo) / bins)).cast("int"), F.lit(bins - 1))


def chi2_stats(df: DataFrame, column: str, other: str, bins: int = 5) -> DataFrame:
    """Independence of a column's gaps from equal-width bins of another."""
    edges = equal_width(df, other, bins)
    held = df.where(num(other).isNotNull())
    at = bin_of(num(other), *edges, bins) if edges else F.lit(0)
    table = held.groupBy(q(column).isNull().cast("string").alias("a"), at.cast("string").alias("b")).agg(F.count("*").alias("n"))
    return chi_square(table)


def mechanism(df: DataFrame, column: str, others: Sequence[str], alpha: float = 0.05) -> dict:
    """MCAR, MAR or MNAR by the share of other columns that the gaps depend on: chi-square over bins and pooled t."""
    ps = []
    for c in list(others)[:5]:
        r = chi2_stats(df, column, c).first()
        if r and r["dof"]:
            ps.append(chi2_sf(r["chi2"], r["dof"]))
    share = sum(p > alpha for p in ps) / len(ps) if ps else 1.0
    kind = "MCAR" if share > 0.8 else "MAR" if share > 0.4 else "MNAR"
    ts = ttest_stats(df, column, list(others)[:10]).collect()
    t_ps = {r["feature"]: t_two_sided(r["t_stat"], r["n_missing"] + r["n_present"] - 2) for r in ts if r["t_stat"] is not None}
    significant = sum(p < alpha for p in t_ps.values()) / len(t_ps) if t_ps else 0.0
    return {"column": column, "mechanism": kind, "independent_share": share, "p_values": ps, "t_p_values": t_ps, "significant_share": significant}


def imputation_method(kind: str, missing_pct: float, mechanism_name: str, skewness: float | None) -> str:
    """The imputation to prefer for a column, given the mechanism found for it."""
    if missing_pct > 50:
        return "drop"
    if kind != "numeric":
        return "mode" if missing_pct < 20 else "constant category"
    if mechanism_name == "MNAR":
        return "model with indicator"
    if mechanism_name == "MAR":
        return "iterative" if missing_pct > 5 else "knn"
    return "median" if skewness is not None and abs(skewness) > 1 else "mean"
