"""Feature engineering and preprocessing: derived columns, encoders, scalers, transforms, text vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import num, q
from ..functions.exprs import corr, div, skew
from ..plans.fuse import fused, row
from ..plans.ordering import bucket_of, numbered
from ..plans.ranks import exact_quantiles


def datetime_parts(df: DataFrame, ts: str) -> DataFrame:
    t, d = q(ts).cast("timestamp"), F.to_date(q(ts))
    return df.withColumns({
        f"{ts}_year": F.year(t), f"{ts}_month": F.month(t), f"{ts}_day": F.dayofmonth(t), f"{ts}_hour": F.hour(t), f"{ts}_dayofweek": F.weekday(t), f"{ts}_quarter": F.quarter(t),
        f"{ts}_weekofyear": F.weekofyear(t), f"{ts}_is_weekend": (F.weekday(t) >= 5).cast("int"), f"{ts}_is_month_start": (F.dayofmonth(t) == 1).cast("int"), f"{ts}_is_month_end": (F.last_day(d) == d).cast("int"),
    })


def cyclical(df: DataFrame, ts: str) -> DataFrame:
    """Sine and cosine of month, weekday, hour and day of year."""
    t = q(ts).cast("timestamp")
    out = {}
    for name, value, period in (("month", F.month(t), 12), ("dow", F.weekday(t), 7), ("hour", F.hour(t), 24), ("doy", F.dayofyear(t), 365)):
        angle = F.lit(2 * math.pi) * value / period
        out |= {f"{ts}_{name}_sin": F.sin(angle), f"{ts}_{name}_cos": F.cos(angle)}
    return df.withColumns(out)


def detect_datetimes(df: DataFrame, cols: Sequence[str], sample: int = 100, least: float = 0.9) -> list[str]:
    """Text columns of which the first non-null values parse as dates."""
    out = []
    for c in cols:
        r = df.select(q(c).cast("string").alias("s")).where("s is not null").limit(sample).agg(F.count("*").alias("n"), F.count(F.col("s").try_cast("timestamp")).alias("k")).first()
        if r["n"] and r["k"] >= least * r["n"]:
            out.append(c)
    return out


def interactions(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Product, ratio (null for a zero divisor), sum and difference of all pairs."""
    out = {}
    for a, b in combinations(cols, 2):
        out |= {f"{a}_x_{b}": num(a) * num(b), f"{a}_div_{b}": div(q(a), q(b)), f"{a}_plus_{b}": num(a) + num(b), f"{a}_minus_{b}": num(a) - num(b)}
    return df.withColumns(out)


def polynomial(df: DataFrame, cols: Sequence[str], degree: int = 2) -> DataFrame:
    """Powers and, for degree above 2, mixed terms with a power, of standardised columns (gaps as 0 first)."""
    x = {c: F.coalesce(num(c), F.lit(0.0)) for c in cols}
    at = {r["feature"]: r for r in fused(df, [row(feature=F.lit(c), m=F.avg(x[c]), s=F.stddev_pop(x[c])) for c in cols]).collect()}
    z = {c: (x[c] - at[c]["m"]) / at[c]["s"] if at[c]["s"] else F.lit(0.0) for c in cols}
    out = {f"{c}^{p}": F.pow(z[c], F.lit(float(p))) for c in cols for p in range(2, degree + 1)}
    if degree > 2:
        out |= {f"{a}^2 {b}": F.pow(z[a], F.lit(2.0)) * z[b] for a in cols for b in cols if a != b}
    return df.withColumns(out)


def text_stats(df: DataFrame, c: str) -> DataFrame:
    words = F.when(F.trim(q(c)) == "", 0).otherwise(F.size(F.split(F.trim(q(c)), r"\s+")))
    return df.withColumns({f"{c}_length": F.length(q(c)), f"{c}_word_count": words, f"{c}_avg_word_length": F.length(q(c)) / (words + 1.0)})


def scaled(df: DataFrame, cols: Sequence[str], method: str = "zscore") -> DataFrame:
    """zscore (population deviation), minmax, robust (median and quartiles) or maxabs; a flat column becomes 0."""
    rows, of_all = [], exact_quantiles(df, cols, [0.25, 0.5, 0.75]) if method == "robust" else {}
    for c in cols:
        x, at = num(c), [F.lit(v).cast("double") for v in of_all.get(c, [None] * 3)]
        of = {"zscore": (F.avg(x), F.stddev_pop(x)), "minmax": (F.min(x), F.max(x) - F.min(x)), "robust": (at[1], at[2] - at[0]), "maxabs": (F.lit(0.0), F.max(F.abs(x)))}[method]
        rows.append(row(feature=F.lit(c), centre=of[0].cast("double"), width=of[1].cast("double")))
    fit = {r["feature"]: r for r in fused(df, rows).collect()}
    scale = lambda c: (num(c) - F.lit(fit[c]["centre"]).cast("double")) / F.lit(fit[c]["width"]) if fit[c]["width"] else F.when(q(c).isNotNull(), 0.0)
    return df.withColumns({f"{c}_{method}": scale(c) for c in cols})


def group_mean(df: DataFrame, by: str, value: str, name: str = "group_mean") -> DataFrame:
    """Rows with the mean of their group, null groups too; the means are joined as their size allows."""
    means = df.groupBy(q(by).alias("__g")).agg(F.avg(num(value)).alias(name))
    return df.join(means, q(by).eqNullSafe(F.col("__g")), "left").drop("__g")


def frequent(df: DataFrame, c: str, k: int | None = None, least_share: float | None = None) -> list[str]:
    """The k most frequent values (ties: value), or those with a share of rows, which are 1 / least_share at most."""
    counts = df.where(q(c).isNotNull()).groupBy(q(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
    if least_share is not None:
        if least_share <= 0:
            raise ValueError("least_share must be above 0")
        total = counts.agg(F.sum("n")).first()[0] or 0
        counts = counts.where(F.col("n") >= least_share * total)
    elif k is None:
        raise ValueError("give k or least_share")
    ordered = counts.orderBy(F.desc("n"), "v")
    return [r["v"] for r in (ordered.limit(k) if k else ordered).collect()]


def rare_to_other(df: DataFrame, c: str, least_share: float = 0.05, other: str = "other") -> DataFrame:
    keep = frequent(df, c, least_share=least_share)
    return df.withColumn(c, F.when(q(c).isNull() | q(c).cast("string").isin(keep), q(c).cast("string")).otherwise(other))


def ordinal(df: DataFrame, c: str, categories: Sequence[str] | None = None) -> DataFrame:
    """Rank of the value among the categories in order; unknown values and null get -1."""
    if categories is None:
        values = df.select(q(c).cast("string").alias("__v")).where("__v is not null").distinct()
        ranks = numbered(values, ["__v"]).select("__v", F.col("__rn").alias(f"{c}_code"))
        out = df.join(ranks, q(c).cast("string") == F.col("__v"), "left").drop("__v")
    else:
        out = df.withColumn(f"{c}_code", F.array_position(F.array(*map(F.lit, categories)), q(c).cast("string")).cast("int") - 1)
    return out.withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)).cast("int"))


def one_hot(df: DataFrame, c: str, k: int = 10) -> DataFrame:
    """Indicators of the k - 1 most frequent values and one of all others, if there are more than k."""
    values = frequent(df, c, k + 1)
    keep = values if len(values) <= k else values[: k - 1]
    out = {f"{c}={v}": F.coalesce((q(c).cast("string") == v).cast("int"), F.lit(0)) for v in keep}
    if len(values) > k:
        out[f"{c}=infrequent"] = F.coalesce((~q(c).cast("string").isin(keep)).cast("int"), F.lit(0))
    return df.withColumns(out)


def yeo_johnson_expr(x: Column, lam: float) -> Column:
    up = F.log1p(F.greatest(x, F.lit(0.0))) if abs(lam) < 1e-12 else (F.pow(F.greatest(x, F.lit(0.0)) + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(F.greatest(-x, F.lit(0.0))) if abs(lam - 2) < 1e-12 else -(F.pow(F.greatest(-x, F.lit(0.0)) + 1, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_lambda(df: DataFrame, c: str, low: float = -3.0, high: float = 5.0, rounds: int = 4, points: int = 17) -> float:
    """Maximum-likelihood power by grids that close in; each round is one scan."""
    x = num(c)
    for _ in range(rounds):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        jac = F.sum(F.signum(x) * F.log1p(F.abs(x)))
        rows = [row(lam=F.lit(g), ll=-F.count(x) / 2.0 * F.log(F.var_pop(yeo_johnson_expr(x, g))) + (g - 1) * jac) for g in grid]
        best = max(fused(df, rows).collect(), key=lambda r: (r["ll"] if r["ll"] is not None else -math.inf))["lam"]
        step = (high - low) / (points - 1)
        low, high = best - step, best + step
    return (low + high) / 2


def yeo_johnson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_yj": yeo_johnson_expr(num(c), yeo_johnson_lambda(df, c)) for c in cols})


def quantile_uniform(df: DataFrame, c: str, points: int = 100) -> DataFrame:
    """Position of the value between the column's quantiles, 0 to 1, linear within a step."""
    cuts = exact_quantiles(df, [c], [i / points for i in range(points + 1)])[c]
    table = F.array(*map(F.lit, cuts))
    at = F.least(bucket_of(num(c), cuts[1:-1]), F.lit(points - 1))
    lo, hi = F.get(table, at), F.get(table, at + 1)
    return df.withColumn(f"{c}_uniform", F.when(num(c).isNotNull(), F.least(F.greatest((at + F.coalesce(F.try_divide(num(c) - lo, hi - lo), F.lit(0.0))) / points, F.lit(0.0)), F.lit(1.0))))


STOP_WORDS = frozenset("a an and are as at be but by for from has have he her his i if in is it its me my no not of on or our she so that the their them they this to us was we were what when which who will with you your".split())


def tfidf(df: DataFrame, key: str, c: str, k: int = 100, pairs: bool = True) -> DataFrame:
    """key, term, weight of the k most frequent terms (words of two characters or more and pairs of them), idf = ln((1 + n) / (1 + df)) + 1, length 1 a text."""
    words = F.filter(F.regexp_extract_all(F.lower(q(c)), F.lit(r"(\w\w+)"), F.lit(1)), lambda w: ~w.isin(list(STOP_WORDS)))
    held = df.select(q(key).alias("key"), words.alias("w"))
    terms = F.concat(F.col("w"), F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.expr("cast(array() as array<string>)"))) if pairs else F.col("w")
    counts = held.select("key", F.explode(terms).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    n = df.count()
    top = counts.groupBy("term").agg(F.sum("tf").alias("all"), F.count("*").alias("df")).orderBy(F.desc("all"), "term").limit(k)
    raw = counts.join(F.broadcast(top), "term").select("key", "term", (F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1)).alias("x"))
    return raw.select("key", "term", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("key")))).alias("weight"))


def anova_f(df: DataFrame, cols: Sequence[str], group: str) -> DataFrame:
    """One-way F of each numeric column over the groups, from grouped sums."""
    held = df.where(q(group).isNotNull())
    per = fused(held.withColumn("__g", q(group).cast("string")), [row(feature=F.lit(c), n=F.count(num(c)).cast("double"), s=F.sum(num(c)), ss=F.sum(num(c) * num(c))) for c in cols], by=["__g"]).where("n > 0")
    got = per.groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("ss") - F.col("b")
    return got.select("feature", F.col("k").alias("n_groups"), div(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))).alias("f_stat"))


def f_regression(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """F of the simple regression of the target on each column, and the importance min(F / 100, 1)."""
    got = fused(df, [row(feature=F.lit(c), n=F.count_if(q(c).isNotNull() & q(target).isNotNull()), r=corr(num(c), num(target))) for c in cols])
    f = div(F.col("r") ** 2 * (F.col("n") - 2), 1 - F.col("r") ** 2)
    return got.select("feature", "n", f.alias("f_stat"), F.least(f / 100, F.lit(1.0)).alias("importance"))


def target_correlations(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    return fused(df, [row(feature=F.lit(c), r=corr(num(c), num(target))) for c in cols])


def correlation_filter(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Which columns stay when the second of each highly correlated pair goes, and 1 - mean |r| (itself included)."""
    pairs = {(a, b): r for a, b, r in fused(df, [row(a=F.lit(a), b=F.lit(b), r=corr(num(a), num(b))) for a, b in combinations(cols, 2)]).collect()}
    size = lambda a, b: 1.0 if a == b else abs(pairs.get((a, b), pairs.get((b, a))) or 0.0)
    dropped = {b for (a, b), r in pairs.items() if r is not None and abs(r) >= threshold}
    rows = [(c, c not in dropped, 1 - sum(size(c, x) for x in cols) / len(cols)) for c in cols]
    return df.sparkSession.createDataFrame(rows, "feature string, kept boolean, score double")


def variance_filter(df: DataFrame, cols: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """Variance of the standardised column (1, or 0 for a constant one) against the threshold."""
    got = fused(df, [row(feature=F.lit(c), std=F.stddev_pop(num(c))) for c in cols])
    z = F.when(F.coalesce("std", F.lit(0.0)) > 0, 1.0).otherwise(0.0)
    return got.select("feature", z.alias("score"), (z >= threshold).alias("kept"))


def slice_metrics(df: DataFrame, slice_col: str, actual: str, predicted: str, least: int = 10, k: int = 10) -> DataFrame:
    """Accuracy and positive rates of the k largest slices of rows (ties: value)."""
    a, p = num(actual), num(predicted)
    got = df.where(q(slice_col).isNotNull()).groupBy(q(slice_col).cast("string").alias("slice")).agg(F.count("*").alias("n"), F.avg((a == p).cast("double")).alias("accuracy"), F.avg(p).alias("predicted_rate"), F.avg(a).alias("actual_rate"))
    return got.where(F.col("n") >= least).orderBy(F.desc("n"), "slice").limit(k)


def error_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    e = num(predicted) - num(actual)
    at = [F.lit(x).cast("double") for x in exact_quantiles(df.select(F.abs(e).alias("e")), ["e"], [0.25, 0.5, 0.75, 0.9, 0.99])["e"]]
    return df.agg(F.count(e).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.stddev_samp(e).alias("error_std"), *(at[i].alias(f"abs_p{p}") for i, p in enumerate((25, 50, 75, 90, 99))))


def classification_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """n, accuracy, error_rate and n_errors over rows that have both; null rates without rows."""
    wrong = (q(actual) != q(predicted)).cast("double")
    return df.agg(F.count(wrong).alias("n"), (1 - F.avg(wrong)).alias("accuracy"), F.avg(wrong).alias("error_rate"), F.coalesce(F.sum(wrong), F.lit(0.0)).cast("long").alias("n_errors"))


def error_correlates(df: DataFrame, cols: Sequence[str], actual: str, predicted: str, k: int = 10) -> DataFrame:
    """The k columns that correlate most with being predicted wrongly (ties: name): feature, r; columns without a correlation are left out."""
    wrong = (q(actual) != q(predicted)).cast("double")
    got = fused(df, [row(feature=F.lit(c), r=corr(num(c), wrong)) for c in cols])
    return got.where("r is not null").orderBy(F.desc(F.abs("r")), "feature").limit(k)


def worst_predictions(df: DataFrame, key: str, actual: str, predicted: str, k: int = 10) -> DataFrame:
    """The k rows with the largest absolute error (ties: key): row_key, actual, predicted, error."""
    e = F.abs(num(predicted) - num(actual))
    rows = df.select(q(key).alias("row_key"), num(actual).alias("actual"), num(predicted).alias("predicted"), e.alias("error")).where("error is not null")
    return rows.orderBy(F.desc("error"), "row_key").limit(k)


def downcasts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The narrowest integer type that holds each whole-number column, from its extremes."""
    got = fused(df, [row(feature=F.lit(c), lo=F.min(num(c)), hi=F.max(num(c)), whole=F.coalesce(F.bool_and(num(c) % 1 == 0), F.lit(False))) for c in cols])
    fits = lambda b: (F.col("lo") >= -(2.0**b)) & (F.col("hi") < 2.0**b)
    kind = F.when(~F.col("whole"), "float").when(fits(7), "tinyint").when(fits(15), "smallint").when(fits(31), "int").otherwise("bigint")
    return got.select("feature", "lo", "hi", kind.alias("narrow_type"))


def memory_usage(df: DataFrame) -> DataFrame:
    """Bytes of each column: fixed widths, or UTF-8 bytes of its text form."""
    widths = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}
    rows = []
    for f in df.schema:
        w = widths.get(f.dataType.typeName())
        rows.append(row(feature=F.lit(f.name), bytes=(F.count("*") * w if w else F.coalesce(F.sum(F.octet_length(q(f.name).cast("string"))), F.lit(0))).cast("long")))
    return fused(df, rows)


def skewness_of(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return fused(df, [row(feature=F.lit(c), skew=skew(num(c))) for c in cols])
