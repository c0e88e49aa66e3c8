"""Leakage within a table and between a training and a test table."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..columns import CATEGORICAL, NUMERIC, columns_of, kind_of, num, q
from ..functions.distributions import ks_sf
from ..functions.exprs import corr, div, ladder
from ..plans.fuse import fused, long_values, row
from ..plans.ordering import bucket_of
from ..plans.ranks import exact_quantiles
from . import drift

#: Words in column names that speak of the target or of what follows it.
NAME_HINTS = ("target", "label", "outcome", "result", "prediction", "score")
#: Vectors of one side that meet those of the other in one task.
VECTOR_BLOCK = 8_192


def _identity(df: DataFrame, cols: Sequence[str], digits: int | None) -> Column:
    """A row's identity as a JSON text that keeps nulls apart."""
    values = [F.round(q(c), digits).alias(c) if digits is not None and df.schema[c].dataType.typeName() in ("double", "float") else q(c).alias(c) for c in cols]
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})


def contamination(train: DataFrame, test: DataFrame, exclude: Sequence[str] = (), round_digits: int | None = None) -> DataFrame:
    """Test rows that occur in the training table (a left semi join on the whole row): counts and rate."""
    cols = [c for c in test.columns if c in train.columns and c not in exclude]
    mark = lambda df: df.select(F.sha2(_identity(df, cols, round_digits), 256).alias("k"))
    seen = mark(train).distinct()
    got = mark(test).join(seen.withColumn("hit", F.lit(1)), "k", "left").agg(F.count("*").alias("n_test"), F.count("hit").alias("n_contaminated"))
    rate = F.coalesce(div(F.col("n_contaminated"), F.col("n_test")) * 100, F.lit(0.0))
    return got.select("n_test", "n_contaminated", rate.alias("rate_pct"), F.when(F.col("n_contaminated") > 0, "critical").otherwise("none").alias("severity"))


def group_overlap(train: DataFrame, test: DataFrame, entity: str) -> DataFrame:
    """Entities that both tables have; more than half of the test's is critical, more than a fifth high."""
    ids = lambda df: df.select(q(entity).alias("e")).where("e is not null").distinct()
    sides = ids(train).withColumn("t", F.lit(1)).unionByName(ids(test).withColumn("t", F.lit(2))).groupBy("e").agg(F.sum("t").alias("t"))
    got = sides.agg(F.count_if(F.col("t") != 2).alias("n_train"), F.count_if(F.col("t") != 1).alias("n_test"), F.count_if(F.col("t") == 3).alias("n_overlap"))
    share = F.coalesce(div(F.col("n_overlap"), F.col("n_test")) * 100, F.lit(0.0))
    level = F.when(F.col("n_overlap") == 0, "none").otherwise(ladder(share, [(20.0, "medium"), (50.0, "high")], "critical", strict=False))
    return got.select("n_train", "n_test", "n_overlap", share.alias("overlap_pct"), level.alias("severity"))


def perfect_correlations(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> DataFrame:
    got = fused(df, [row(feature_1=F.lit(a), feature_2=F.lit(b), r=corr(num(a), num(b))) for a, b in combinations(cols, 2)])
    return got.where(F.abs("r") >= threshold).withColumn("severity", F.when(F.abs("r") >= 0.99, "Critical").otherwise("High"))


def duplicate_numeric(df: DataFrame, cols: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Pairs whose correlation with gaps as 0 is high; columns with more gaps than values are left out."""
    zero = lambda c: F.coalesce(num(c), F.lit(0.0))
    half = lambda c: F.count(num(c)) * 2 >= F.count("*")
    got = fused(df, [row(feature_1=F.lit(a), feature_2=F.lit(b), similarity=F.abs(corr(zero(a), zero(b))), usable=half(a) & half(b)) for a, b in combinations(cols, 2)])
    return got.where(F.col("usable") & (F.col("similarity") >= threshold)).drop("usable")


def duplicate_categories(df: DataFrame, cols: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Pairs whose sets of distinct values are alike (Jaccard), from one list of (value, columns)."""
    seen = long_values(df, cols).where("value is not null").distinct()
    sizes = seen.groupBy("feature").agg(F.count("*").alias("k"))
    per_value = seen.groupBy("value").agg(F.collect_set("feature").alias("fs"))  # at most one entry a column
    both = per_value.select(F.explode("fs").alias("feature_1"), "fs").select("feature_1", F.explode("fs").alias("feature_2")).where("feature_1 < feature_2").groupBy("feature_1", "feature_2").agg(F.count("*").alias("common"))
    a, b = sizes.select(F.col("feature").alias("feature_1"), F.col("k").alias("k1")), sizes.select(F.col("feature").alias("feature_2"), F.col("k").alias("k2"))
    out = both.join(F.broadcast(a), "feature_1").join(F.broadcast(b), "feature_2")
    return out.select("feature_1", "feature_2", div(F.col("common"), F.col("k1") + F.col("k2") - F.col("common")).alias("similarity")).where(F.col("similarity") >= threshold)


def perfect_predictors(df: DataFrame, cols: Sequence[str], target: str, least: int = 5) -> DataFrame:
    """Whether each value of a feature goes with one value of the target only, and how key-like the feature is."""
    pairs = long_values(df.where(q(target).isNotNull()).withColumn("__t", q(target).cast("string")), cols, keep=["__t"]).where("value is not null")
    per = pairs.groupBy("feature", "value").agg(F.count("*").alias("n"), F.min("__t").alias("lo"), F.max("__t").alias("hi"))
    got = per.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("n_values"), F.count_if(F.col("lo") == F.col("hi")).alias("n_pure"))
    return got.select("feature", "n", "n_values", ((F.col("n") >= least) & (F.col("n_pure") == F.col("n_values"))).alias("is_perfect"), div(F.col("n_values"), F.col("n")).alias("key_likeness"), div(F.col("n_pure"), F.col("n_values")).alias("pure_share"))


def information_scores(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str) -> DataFrame:
    """|r| with gaps as 0 for numbers; share of pure groups for categories; above 0.8 is flagged."""
    zero = lambda c: F.coalesce(num(c), F.lit(0.0))
    parts = []
    if numeric:
        parts.append(fused(df, [row(feature=F.lit(c), score=F.coalesce(F.abs(corr(zero(c), zero(target))), F.lit(0.0))) for c in numeric]))
    if categorical:
        parts.append(perfect_predictors(df, categorical, target).select("feature", F.col("pure_share").alias("score")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("level", ladder(F.col("score"), [(0.8, "none"), (0.9, "Medium")], "High", strict=False))


def future_dates(df: DataFrame, cols: Sequence[str], as_of: str) -> DataFrame:
    """Dates after as_of and the earliest year."""
    at = F.lit(as_of).cast("timestamp")
    rows = []
    for c in cols:
        ts = q(c).cast("timestamp")
        rows.append(row(feature=F.lit(c), n=F.count(ts), n_future=F.count_if(ts > at), future_pct=F.coalesce(div(F.count_if(ts > at), F.count(ts)) * 100, F.lit(0.0)), before_1900=F.coalesce(F.year(F.min(ts)) < 1900, F.lit(False))))
    return fused(df, rows)


def binned_information(df: DataFrame, features: str | Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Plug-in mutual information (nats) of numeric features in quantile bins with a categorical target; null without values.

    One scan finds the bins of all features, one more their counts.
    """
    features = [features] if isinstance(features, str) else list(features)
    edges = {c: sorted(set(at) - {None}) for c, at in exact_quantiles(df, features, [i / bins for i in range(1, bins)]).items()}
    entries = F.array(*(F.struct(F.lit(c).alias("feature"), F.when(num(c).isNotNull(), bucket_of(num(c), edges[c])).alias("a")) for c in features))
    binned = df.where(q(target).isNotNull()).select(F.inline(entries), q(target).cast("string").alias("b")).where(F.col("a").isNotNull())
    cells = binned.groupBy("feature", "a", "b").agg(F.count("*").cast("double").alias("n"))
    wa, wb, every = Window.partitionBy("feature", "a"), Window.partitionBy("feature", "b"), Window.partitionBy("feature")
    full = cells.select("feature", "n", F.sum("n").over(wa).alias("na"), F.sum("n").over(wb).alias("nb"), F.sum("n").over(every).alias("t"))
    got = full.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    return df.sparkSession.createDataFrame([(c,) for c in features], "feature string").join(F.broadcast(got), "feature", "left")


def suspicious_names(cols: Sequence[str], target: str, hints: Sequence[str] = NAME_HINTS) -> list[str]:
    low = target.lower()
    return [c for c in cols if c != target and (low in c.lower() or any(h in c.lower() for h in hints))]


def near_duplicates(train: DataFrame, test: DataFrame, vec: str, key: str, threshold: float = 0.95, block: int = VECTOR_BLOCK) -> DataFrame:
    """Test vectors with a training vector of cosine similarity of threshold or more: key, other, cosine, the best (ties: least other), and
    first, the least training key among all that near.

    No pair is missed: blocks of either side meet in one task each, as a product of matrices, so the work grows with the product of the
    sides while a task's memory does not. Equal training vectors go as one. Vectors of different lengths never match, those with a gap,
    of length zero or infinite match nothing.
    """
    gap = F.exists(q(vec), lambda x: x.isNull() | F.isnan(x.cast("double")))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where(q(vec).isNotNull() & ~gap).select(q(key).alias(name), F.size(q(vec)).alias("d"), q(vec).alias("v"))

    a = side(train, "other").groupBy("d", "v").agg(F.min("other").alias("other"))
    b = side(test, "k").distinct()
    wide, high = (max(1, math.ceil(df.count() / block)) for df in (a, b))
    dealt = lambda name, n: F.pmod(F.xxhash64(name, "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = b.select("k", "v", "d", dealt("k", high).alias("i"), every(wide).alias("j"))
    right = a.select("other", "v", "d", dealt("other", wide).alias("j"), every(high).alias("i"))
    tasks = min(wide * high, 512)
    kinds = pa.schema([("k", to_arrow_type(b.schema["k"].dataType)), *((c, to_arrow_type(a.schema["other"].dataType)) for c in ("other", "first")), ("cosine", pa.float64())])

    def meet(tests: pa.Table, trains: pa.Table) -> pa.Table:
        if not len(tests) or not len(trains):
            return kinds.empty_table()
        trains = trains.sort_by("other")
        x, y = (unit_rows(t.column("v").combine_chunks()) for t in (tests, trains))
        rows, best, first, cosine = [], [], [], []
        for lo in range(0, len(x), 256):
            c = x[lo : lo + 256] @ y.T
            at = np.flatnonzero((c >= threshold).any(1))
            near = np.where(c[at] >= threshold, np.round(c[at], 9), -2.0)
            rows.append(at + lo)
            best.append(near.argmax(1))
            first.append((near > -2).argmax(1))
            cosine.append(near.max(1, initial=-2.0))
        take = lambda t, name, i: t.column(name).take(pa.array(np.concatenate([*i, np.zeros(0, np.int64)])))
        got = [take(tests, "k", rows), take(trains, "other", best), take(trains, "other", first), pa.array(np.concatenate([*cosine, np.zeros(0)]))]
        return pa.Table.from_arrays(got, names=kinds.names).cast(kinds)

    kind = lambda df, name: df.schema[name].dataType.simpleString()
    tiles = [df.repartition(tasks, "i", "j", "d").groupBy("i", "j", "d") for df in (left, right)]
    found = tiles[0].cogroup(tiles[1]).applyInArrow(meet, f"k {kind(b, 'k')}, other {kind(a, 'other')}, first {kind(a, 'other')}, cosine double")
    best = found.groupBy("k").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "other")).alias("m"), F.min("first").alias("first"))
    return best.select("k", F.col("m.other").alias("other"), (-F.col("m.c")).alias("cosine"), "first")


def unit_rows(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows of length one; of those without a finite length above zero as rows of NaN, which are near nothing."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    with np.errstate(all="ignore"):
        length = np.sqrt(np.square(x).sum(1, keepdims=True))
        return np.where(np.isfinite(length) & (length > 0), x / length, np.nan)


def leakage_score(n_corr: int, n_dup: int, n_perfect: int, n_high: int, n_temporal: int, n_mi: int) -> float:
    return float(min(100, min(15 * n_corr, 30) + min(10 * n_dup, 25) + 20 * n_perfect + min(5 * n_high, 20) + 15 * n_temporal + min(8 * n_mi, 15)))


def ranked_shift(train: DataFrame, test: DataFrame, cols: Sequence[str], alpha: float = 0.001, top: int = 20) -> DataFrame:
    """Numeric columns whose distributions differ between train and test, most first: feature, ks_stat, p_value, rank.

    A report of at most top columns, as alpha bounds the asymptotic p-value of the Kolmogorov-Smirnov statistic.
    """
    found = []
    for c in cols:
        r = drift.ks(train, test, c).first()
        if r["n_baseline"] and r["n_current"]:
            p = ks_sf(r["ks_stat"], r["n_baseline"], r["n_current"])
            found.append((c, float(r["ks_stat"]), float(p)))
    found = sorted((f for f in found if f[2] < alpha), key=lambda f: (-f[1], f[0]))[:top]
    return train.sparkSession.createDataFrame([(*f, n) for n, f in enumerate(found, 1)], "feature string, ks_stat double, p_value double, rank int")


def detect_all(train: DataFrame, test: DataFrame, target: str | None = None, entity: str | None = None, vec: str | None = None, key: str | None = None, threshold: float = 0.95) -> DataFrame:
    """All findings about a training and a test table: type, severity, features, description, recommendation.

    Contamination by whole rows, near duplicates of the vector column vec (with key), entities in both tables, target
    leakage in train (correlation with the target, perfect predictors that are no keys, telling names) and shifted
    columns. The findings are as many as the columns at most; :func:`severity_counts` adds them up.
    """
    nums = [c for c in columns_of(train, NUMERIC) if c in test.columns]
    out: list[tuple] = []
    r = contamination(train, test).first()
    if r["n_contaminated"]:
        out.append(("train_test_contamination", "critical", [], f"{r['n_contaminated']} of {r['n_test']} test rows occur in train", "remove them from the test table"))
    if vec and key:
        n = near_duplicates(train, test, vec, key, threshold).count()
        if n:
            out.append(("near_duplicates", "high", [vec], f"{n} test rows have a near copy in train", "split near copies to one side"))
    if entity:
        r = group_overlap(train, test, entity).first()
        if r["n_overlap"]:
            out.append(("group_leakage", r["severity"], [entity], f"{r['n_overlap']} entities are in both tables ({r['overlap_pct']:.1f} %)", "split by entity"))
    if target:
        others = [c for c in train.columns if c != target]
        if target in columns_of(train, NUMERIC):
            for r in fused(train, [row(feature=F.lit(c), r=corr(num(c), num(target))) for c in nums if c != target]).collect() if len(nums) > 1 else []:
                if r["r"] is not None and abs(r["r"]) >= threshold:
                    out.append(("target_leakage", "critical", [r["feature"]], f"correlates with the target ({r['r']:.3f})", "drop it, or show that it is known in time"))
        flat = [c for c in others if kind_of(train.schema[c]) in (NUMERIC, CATEGORICAL)]
        for r in perfect_predictors(train, flat, target).where("is_perfect and key_likeness < 0.95").orderBy("feature").collect() if flat else []:
            out.append(("perfect_predictor", "critical", [r["feature"]], "each of its values goes with one target value", "drop it, or show that it is known in time"))
        for c in suspicious_names(others, target):
            out.append(("suspicious_name", "medium", [c], "its name speaks of the target", "check when it is known"))
    shifted = [r["feature"] for r in ranked_shift(train, test, [c for c in nums if c != target]).orderBy("rank").collect()]
    if shifted:
        out.append(("distribution_shift", "medium", shifted, f"{len(shifted)} columns differ between train and test", "review how the tables were split"))
    return train.sparkSession.createDataFrame(out, "type string, severity string, features array<string>, description string, recommendation string")


def severity_counts(findings: DataFrame) -> DataFrame:
    """How many findings there are, and of each severity."""
    return findings.agg(F.count("*").alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium")))
