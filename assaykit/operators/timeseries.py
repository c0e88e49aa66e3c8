"""Time series: gaps, autocorrelation, trend, stationarity, look-ahead, window features, segment stability.

A series is numbered once by its order columns (sorted ranges, no single-task window); lags and rolling frames then
run over blocks of consecutive rows with copies of their neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import num, q
from ..functions.distributions import corr_p
from ..functions.exprs import corr, div
from ..plans.fuse import fused, row
from ..plans.ordering import blocked, checkpointed, numbered, prefix_sums
from ..plans.ranks import medians

EWM_REACH = 127


def series(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows numbered by the order columns (column __rn, from 0)."""
    return numbered(df, [q(c) for c in order])


def coverage(df: DataFrame, ts: str) -> DataFrame:
    t = q(ts).cast("timestamp")
    rows = df.where(q(ts).isNotNull()).select(t.alias("t"))
    got = rows.agg(
        F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.count_distinct(F.to_date("t")).alias("unique_dates"),
        F.mode(F.hour("t"), True).alias("modal_hour"), F.mode(F.weekday("t"), True).alias("modal_weekday"),
    )
    span = F.floor((F.unix_micros("hi") - F.unix_micros("lo")) / 86_400_000_000).cast("long")
    return got.select("n", F.unix_seconds("lo").alias("first_s"), F.unix_seconds("hi").alias("last_s"), span.alias("span_days"), "unique_dates", div(F.col("n"), span).alias("per_day"), "modal_hour", "modal_weekday")


def gaps(df: DataFrame, ts: str, order: Sequence[str] | None = None, factor: float = 2.0) -> DataFrame:
    """Steps longer than factor times the median step: after (seconds), gap_s."""
    dealt, w = blocked(series(df, order or [ts]), before=1)
    micros = F.unix_micros(q(ts).cast("timestamp"))
    steps = checkpointed(dealt.select("__own", micros.alias("at"), (micros - F.lag(micros).over(w)).alias("d")).where("__own and d is not null"))
    mid = F.lit(medians(steps, ["d"])["d"]).cast("double")
    return steps.where(F.col("d") > factor * mid).select((F.col("at") - F.col("d")).alias("after_us"), F.col("d").alias("gap_us"))


def gap_summary(df: DataFrame, ts: str, order: Sequence[str] | None = None, factor: float = 2.0) -> DataFrame:
    n = df.agg((F.count("*") - 1).alias("n_steps")).withColumn("one", F.lit(1))
    found = gaps(df, ts, order, factor).agg(F.count("*").alias("n_gaps"), F.max("gap_us").alias("largest_us"), F.min("gap_us").alias("smallest_us")).withColumn("one", F.lit(1))
    return found.join(F.broadcast(n), "one").select("n_steps", "n_gaps", F.coalesce(div(F.col("n_gaps"), F.col("n_steps")) * 100, F.lit(0.0)).alias("gap_pct"), "largest_us", "smallest_us")


def autocorrelation(df: DataFrame, value: str, order: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """Biased autocorrelation at each lag: sum of (x - m)(x+k - m) / n over the population variance."""
    held = series(df.where(num(value).isNotNull()), order)
    m, n = held.agg(F.avg(num(value)), F.count("*")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "lag int, n long, acf double, significant boolean")
    dealt, w = blocked(held, after=max(lags))
    centred = dealt.select("__own", (num(value) - F.lit(m)).alias("x"), *(F.lead(num(value) - F.lit(m), k).over(w).alias(f"x{k}") for k in lags)).where("__own")
    rows = [row(lag=F.lit(k), n=F.lit(n).cast("long"), acf=div(F.sum(F.col("x") * F.col(f"x{k}")), F.sum(F.col("x") * F.col("x")))) for k in lags]
    return fused(centred, rows).withColumn("significant", F.abs("acf") > 1.96 / F.sqrt(F.col("n")))


def ljung_box(acf: DataFrame, lags: int = 10) -> DataFrame:
    """Q over the first lags."""
    part = F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))
    return acf.where(F.col("lag") <= lags).agg((F.first("n") * (F.first("n") + 2) * F.sum(part)).alias("q"), F.count("*").alias("dof"))


def seasonality(df: DataFrame, value: str, order: Sequence[str], periods: Sequence[int] = (24, 7, 4, 12)) -> DataFrame:
    """Periods by |autocorrelation| (the strongest above 0.3 counts as seasonal)."""
    n = df.where(num(value).isNotNull()).count()
    usable = sorted({p for p in periods if n >= 30 and n > 3 * p})
    if not usable:
        return df.sparkSession.createDataFrame([], "period int, acf double, seasonal boolean")
    return autocorrelation(df, value, order, usable).select(F.col("lag").alias("period"), "acf", (F.abs("acf") > 0.3).alias("seasonal"))


def trend(df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Least squares on the row number: slope, intercept, r."""
    held = series(df.where(num(value).isNotNull()), order)
    x, y = F.col("__rn").cast("double"), num(value)
    return held.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), corr(y, x).alias("r")).withColumn(
        "direction", F.when(F.abs(F.coalesce("r", F.lit(0.0))) < 0.1, "none").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    )


def trend_p_value(r: float, n: int) -> float:
    return corr_p(r, n)


def dickey_fuller(df: DataFrame, value: str, order: Sequence[str], critical: float = -2.86) -> DataFrame:
    """t statistic of the level in the regression of the change on the level before."""
    dealt, w = blocked(series(df.where(num(value).isNotNull()), order), before=1)
    pairs = dealt.select("__own", F.lag(num(value)).over(w).alias("x"), (num(value) - F.lag(num(value)).over(w)).alias("y")).where("__own and x is not null")
    got = pairs.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    error = F.sqrt(div(div(F.col("syy") - F.col("b") * F.col("sxy"), F.col("n") - 2), F.col("sxx")))
    return got.select("n", F.col("b").alias("coefficient"), div(F.col("b"), error).alias("t_stat")).withColumn("stationary", F.coalesce(F.col("t_stat") < critical, F.lit(False)))


def look_ahead(df: DataFrame, features: Sequence[str], target: str, order: Sequence[str]) -> DataFrame:
    """Correlation of each feature with the target now and one row later; above 0.8 later hints at leakage."""
    dealt, w = blocked(series(df, order), after=1)
    ahead = dealt.withColumn("__next", F.lead(num(target)).over(w)).where("__own")
    got = fused(ahead, [row(feature=F.lit(c), r_now=corr(num(c), num(target)), r_next=corr(num(c), F.col("__next"))) for c in features])
    return got.withColumn("look_ahead", F.coalesce(F.abs("r_next") > 0.8, F.lit(False))).withColumn("too_close", F.coalesce(F.abs("r_now") > 0.95, F.lit(False)))


def lag_features(df: DataFrame, value: str, order: Sequence[str], lags: Sequence[int]) -> DataFrame:
    dealt, w = blocked(series(df, order), before=max(lags))
    x = num(value)
    padded = F.last(x, ignorenulls=True).over(w.rowsBetween(-max(lags), 0))
    out = dealt.withColumns({f"lag_{k}": F.lag(x, k).over(w) for k in lags} | {"diff_1": x - F.lag(x).over(w), "__pad": padded})
    return out.withColumn("pct_change", div(F.col("__pad"), F.lag("__pad").over(w)) - 1).where("__own").drop("__own", "__block", "__pad")


def rolling_features(df: DataFrame, value: str, order: Sequence[str], windows: Sequence[int] = (3, 7, 14, 30)) -> DataFrame:
    dealt, w = blocked(series(df, order), before=max(windows) - 1)
    x, cols = num(value), {}
    for k in windows:
        f = w.rowsBetween(1 - k, 0)
        cols |= {f"mean_{k}": F.avg(x).over(f), f"std_{k}": F.stddev_samp(x).over(f), f"min_{k}": F.min(x).over(f), f"max_{k}": F.max(x).over(f)}
    return dealt.withColumns(cols).where("__own").drop("__own", "__block")


def ewm_mean(df: DataFrame, value: str, order: Sequence[str], span: int = 7) -> DataFrame:
    """Exponentially weighted mean by position, gaps skipped; weights beyond EWM_REACH rows are below 1e-15."""
    decay = 1 - 2 / (span + 1)
    dealt, w = blocked(series(df, order), before=EWM_REACH)
    held = F.collect_list(F.struct(F.col("__rn").alias("i"), num(value).alias("x"))).over(w.rowsBetween(-EWM_REACH, 0))
    weigh = lambda i: F.pow(F.lit(decay), (F.col("__rn") - i).cast("double"))
    sums = F.aggregate(
        held, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")),
        lambda s, e: F.when(e["x"].isNull(), s).otherwise(F.struct((s["a"] + weigh(e["i"]) * e["x"]).alias("a"), (s["b"] + weigh(e["i"])).alias("b"))), lambda s: F.try_divide(s["a"], s["b"]),
    )
    return dealt.withColumn("ewm", sums).where("__own").drop("__own", "__block")


def segment_stability(df: DataFrame, cols: Sequence[str], order: Sequence[str], segments: int | None = None) -> DataFrame:
    """1 / (1 + cv of segment means + cv of segment deviations) over consecutive segments; below 0.7 is unstable."""
    held = series(df, order)
    n = held.count()
    k = segments or max(1, min(5, n // 100))
    size = max(1, n // k)
    at = F.least(F.lit(k - 1), F.expr(f"cast(__rn div {size} as int)"))
    per = fused(held.withColumn("__seg", at), [row(feature=F.lit(c), m=F.avg(num(c)), s=F.stddev_pop(num(c))) for c in cols], by=["__seg"])
    cv = lambda c: F.coalesce(div(F.stddev_pop(c), F.abs(F.avg(c))), F.lit(0.0))
    got = per.groupBy("feature").agg(F.count("*").alias("n_segments"), (1 / (1 + cv("m") + cv("s"))).alias("stability"))
    return got.withColumn("unstable", F.col("stability") < 0.7)


def quality_score(n_gaps: int, biased: bool) -> float:
    return 100.0 - min(2 * n_gaps, 20) - (30 if biased else 0)


def shifted_targets(df: DataFrame, value: str, order: Sequence[str], ahead: Sequence[int] = (1, 3, 7)) -> DataFrame:
    """Future values beside each row, as fixtures of temporal leakage."""
    dealt, w = blocked(series(df, order), after=max(ahead))
    return dealt.withColumns({f"lead_{k}": F.lead(num(value), k).over(w) for k in ahead}).where("__own").drop("__own", "__block")


def percentile_rank(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with the share of rows below: value, n, below_pct."""
    counts = df.where(num(column).isNotNull()).groupBy(num(column).alias("value")).agg(F.count("*").alias("n"))
    run = prefix_sums(counts, "value", {"upto": F.col("n")})
    total = counts.agg(F.sum("n").alias("total")).withColumn("one", F.lit(1))
    return run.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("value", "n", (div(F.col("upto") - F.col("n"), F.col("total")) * 100).alias("below_pct"))
