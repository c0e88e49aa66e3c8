"""Leakage of one table in one call: what each check finds, the score, and what to do about it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import CATEGORICAL, NUMERIC, columns_of, infer_task, num, q
from . import leakage, profile
from .neighbours import neighbour_information
from .prepare import infer_types

# Words in column names that tell of results, and of times.
RESULT_WORDS = ("result", "outcome", "prediction", "label", "class", "category", "decision", "verdict", "conclusion", "answer", "response", "target", "goal", "objective", "success", "failure")
TIME_WORDS = ("created", "updated", "modified", "timestamp", "date", "time", "processed", "completed", "finished", "ended", "closed")
#: Normalised information from which a column is flagged, and from which it is critical.
INFORMATION, CRITICAL = 0.6, 0.8
#: Distinct values relative to rows from which a feature is a key, which goes with one target value by nature.
KEY_LIKE = 0.95

FINDING = "kind string, severity string, feature string, other string, value double, detail string"


def target_statistics(df: DataFrame, target: str) -> dict:
    """Kind of task, distinct values, and the class counts or mean, deviation and extremes of the target, from counts of its values."""
    task = infer_task(df, target)
    if task == "classification":
        counts = df.where(q(target).isNotNull()).groupBy(q(target).cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").collect()  # a task of classes has few
        return {"task": task, "n": sum(r["n"] for r in counts), "distinct": len(counts), "mode": counts[0]["v"] if counts else None, "classes": {r["v"]: r["n"] for r in counts}}
    r = df.agg(F.count(num(target)), F.countDistinct(num(target)), F.avg(num(target)), F.stddev_samp(num(target)), F.min(num(target)), F.max(num(target))).first()
    return {"task": task, **dict(zip(("n", "distinct", "mean", "std", "min", "max"), r))}


def temporal(df: DataFrame, cols: Sequence[str], as_of: str) -> list[tuple]:
    """Times after as_of and before 1900 in time columns (also text that reads as times), and other columns with names of times."""
    types = infer_types(df, cols)
    times = [c for c in types.datetime if types.converted.get(c) is None or types.converted[c] == "datetime"]
    out: list[tuple] = []
    read = df.select(*(q(c).cast("string").try_cast("timestamp").alias(c) for c in times)) if times else None
    for r in leakage.future_dates(read, times, as_of).collect() if times else []:
        if r["n_future"]:
            out.append(("temporal", "Critical", r["feature"], None, r["future_pct"], f"{r['n_future']} times lie after {as_of}"))
        if r["before_1900"]:
            out.append(("temporal", "Medium", r["feature"], None, None, "times before 1900"))
    for c in (c for c in cols if c not in times):
        word = next((w for w in TIME_WORDS if w in c.lower()), None)
        if word:
            out.append(("temporal_name", "Low", c, None, None, f"its name speaks of a time ({word})"))
    return out


def information(df: DataFrame, nums: Sequence[str], target: str) -> DataFrame:
    """feature, normalised: of a numeric target by nearest neighbours; of classes the plug-in over bins relative to the classes' entropy in bits."""
    if infer_task(df, target) != "classification":
        return neighbour_information(df, nums, target).select("feature", "normalised")
    counts = [r[0] for r in df.where(q(target).isNotNull()).groupBy(q(target)).count().select("count").collect()]
    total = sum(counts)
    bits = -sum(n / total * math.log2(n / total) for n in counts) if total else 0.0
    return leakage.binned_information(df, nums, target).select("feature", (F.coalesce("mi", F.lit(0.0)) / F.lit(bits) if bits > 0 else F.lit(0.0)).alias("normalised"))


def table_report(df: DataFrame, target: str | None = None, as_of: str | None = None, threshold: float = 0.8) -> dict:
    """findings (a DataFrame: kind, severity, feature, other, value, detail), counts by kind, target, score (0 to 100, lower is better) and recommendations.

    as_of: the moment after which times lie in the future (default: now). Findings are as many as the columns and their
    pairs at most. Perfect predictors that are keys are left out.
    """
    as_of = as_of or str(df.select(F.current_timestamp()).first()[0])
    nums, cats = columns_of(df, NUMERIC), columns_of(df, CATEGORICAL)
    found: list[tuple] = []
    if len(nums) > 1:
        found += [("perfect_correlation", r["severity"], r["feature_1"], r["feature_2"], r["r"], "rises and falls with the other") for r in leakage.perfect_correlations(df, nums).orderBy("feature_1", "feature_2").collect()]
        found += [("duplicate", "High", r["feature_1"], r["feature_2"], r["similarity"], "says the same as the other") for r in leakage.duplicate_numeric(df, nums).orderBy("feature_1", "feature_2").collect()]
    if len(cats) > 1:
        found += [("duplicate", "High", r["feature_1"], r["feature_2"], r["similarity"], "has the same values as the other") for r in leakage.duplicate_categories(df, cats).orderBy("feature_1", "feature_2").collect()]
    statistics = None
    if target:
        statistics = target_statistics(df, target)
        others = [c for c in nums + cats if c != target]
        predictors = {r["feature"]: r for r in leakage.perfect_predictors(df, others, target).collect()} if others else {}
        keys = {c for c, r in predictors.items() if r["key_likeness"] is not None and r["key_likeness"] >= KEY_LIKE}
        found += [("perfect_predictor", "Critical", c, target, r["pure_share"], "each of its values goes with one target value") for c, r in sorted(predictors.items()) if r["is_perfect"] and c not in keys]
        own_nums = [c for c in nums if c != target] if target in nums else []
        own_cats = [c for c in cats if c != target and c not in keys]
        if own_nums or own_cats:
            scores = leakage.information_scores(df, own_nums, own_cats, target).where(F.col("score") > threshold)
            found += [("high_information", r["level"], r["feature"], target, r["score"], "tells most of the target") for r in scores.orderBy("feature").collect()]
        usable = [c for c in nums if c != target]
        if usable:
            told = information(df, usable, target).where(F.col("normalised") > INFORMATION)
            found += [("high_mutual_information", "Critical" if r["normalised"] > CRITICAL else "High", r["feature"], target, r["normalised"], "shares most of the target's information") for r in told.orderBy("feature").collect()]
        found += [("suspicious_name", "Medium", c, target, None, "its name speaks of a result") for c in leakage.suspicious_names([c for c in df.columns if c != target], target, RESULT_WORDS)]
    found += temporal(df, df.columns, as_of)
    found += [("constant", "Low", r["feature"], None, None, "has one value only") for r in profile.constants(df, df.columns).where("flag = 'constant'").collect()]
    counts: dict[str, int] = {}
    for f in found:
        counts[f[0]] = counts.get(f[0], 0) + 1
    late = sum(f[0] == "temporal" and f[1] == "Critical" for f in found)
    at = lambda k: counts.get(k, 0)
    score = leakage.leakage_score(at("perfect_correlation"), at("duplicate"), at("perfect_predictor"), at("high_information"), late, at("high_mutual_information"))
    return {"findings": df.sparkSession.createDataFrame(found, FINDING), "counts": counts, "target": statistics, "score": score, "recommendations": advice(found)}


def advice(found: Sequence[tuple]) -> list[str]:
    """One line for each kind of finding that calls for action, the gravest first; one line if there is none."""
    of = lambda *kinds: [f for f in found if f[0] in kinds]
    names = lambda fs: ", ".join(sorted({f[2] for f in fs}))
    out = []
    for kinds, text in (
        (("perfect_predictor",), "Remove, as they give the target away: {}."), (("perfect_correlation", "duplicate"), "Keep one of each pair of columns that say the same: {}."),
        (("high_information", "high_mutual_information"), "Find out when these become known, as they tell most of the target: {}."), (("suspicious_name",), "Check by their names whether these are results: {}."),
        (("constant",), "Drop columns of one value: {}."),
    ):
        if hits := of(*kinds):
            out.append(text.format(names(hits)))
    if late := [f for f in of("temporal") if f[1] == "Critical"]:
        out.insert(0, f"Correct or drop times in the future: {names(late)}.")
    if out:
        return [*out, "Split the table by time or entity before a model is trained, and fit every preparation on the training part only."]
    return ["No leakage was found."]
