"""Outliers by several detectors at once: guard, votes, summaries, and what leaving the outliers out does to a model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import NUMERIC, columns_of, infer_task, num, q
from ..plans.ordering import checkpointed
from . import neighbours, outlier
from .modelling import assembled, dbscan, forest, isolation_forest

METHODS = ("iqr", "zscore", "isolation_forest", "lof", "dbscan")
#: Rows without a gap that a detector needs.
LEAST_ROWS = 10


def detect(df: DataFrame, key: str, cols: Sequence[str] | None = None, methods: Sequence[str] = METHODS, contamination: float = 0.05, context: str | None = None, share: float = 0.5) -> dict:
    """Runs detectors and votes.

    Returns rows (row_key, by_<method>, votes, is_outlier: votes of max(1, int(share of the methods that ran))), by_method
    (method, n_outliers, outlier_pct, error), by_column (fences and z-scores), contextual (if a context column is named) and
    summary (a row). key must be unique. With fewer than LEAST_ROWS rows without gaps no detector runs, every error says so,
    and no row is an outlier.
    """
    if unknown := [m for m in methods if m not in METHODS]:
        raise ValueError(f"unknown methods {unknown}; expected some of {', '.join(METHODS)}")
    spark = df.sparkSession
    cols = list(cols or columns_of(df, NUMERIC, but=(key,)))
    complete = df.where(reduce(lambda a, b: a & b, (num(c).isNotNull() for c in cols))) if cols else df.limit(0)
    enough = complete.limit(LEAST_ROWS).count() >= LEAST_ROWS
    ran = list(methods) if enough else []
    marks = outlier.flags(df, cols) if {"iqr", "zscore"} & set(ran) else {}
    rows = df.select(q(key).alias("row_key"), *(marks[m].alias(f"by_{m}") for m in ("iqr", "zscore") if m in ran))
    models = {
        "isolation_forest": lambda: isolation_forest(df, key, cols, contamination=contamination).select("row_key", "is_outlier"),
        "lof": lambda: neighbours.local_outliers(df, key, cols, contamination=contamination).select("row_key", "is_outlier"),
        "dbscan": lambda: dbscan(df, key, cols).select("row_key", F.col("is_noise").alias("is_outlier")),
    }
    for m in (m for m in models if m in ran):
        rows = rows.join(models[m]().withColumnRenamed("is_outlier", f"by_{m}"), "row_key", "left")
    votes = sum((F.coalesce(F.col(f"by_{m}"), F.lit(False)).cast("int") for m in ran), F.lit(0))
    least = max(1, int(len(ran) * share))
    held = checkpointed(rows.select("row_key", *(F.coalesce(F.col(f"by_{m}"), F.lit(False)).alias(f"by_{m}") for m in ran), votes.alias("votes"), (votes >= least).alias("is_outlier")))
    n, flagged, *each = held.agg(F.count("*"), F.count_if("is_outlier"), *(F.count_if(f"by_{m}") for m in ran)).first()
    pct = lambda k: k / n * 100 if n else 0.0
    of = dict(zip(ran, each))
    by_method = spark.createDataFrame([(m, of.get(m), pct(of[m]) if m in of else None, None if m in of else f"fewer than {LEAST_ROWS} complete rows") for m in methods], "method string, n_outliers long, outlier_pct double, error string")
    out = {"rows": held, "by_method": by_method, "summary": {"rows": n, "columns": len(cols), "methods": len(ran), "outliers": flagged, "outlier_pct": pct(flagged)}}
    if enough:
        z = outlier.zscore_outliers(df, cols).select("feature", F.col("n_outliers").alias("n_zscore"), "max_z")
        out["by_column"] = outlier.iqr_outliers(df, cols).join(F.broadcast(z), "feature")
        if context:
            out["contextual"] = outlier.by_context(df, cols, context)
    return out


def cv_scores(df: DataFrame, cols: Sequence[str], target: str, task: str, folds: int = 5, trees: int = 50, depth: int = 10, seed: int = 42) -> list[float]:
    """Scores of a forest on each held-out fold: accuracy, or less the mean squared error. Folds go by a hash of the row."""
    data, _ = assembled(df, cols, target, task)
    rows = checkpointed(data.select("features", "label", F.pmod(F.xxhash64(F.lit(seed), "label", vector_to_array("features")), F.lit(folds)).alias("__fold")))
    judge, sign = (MulticlassClassificationEvaluator(metricName="accuracy"), 1) if task == "classification" else (RegressionEvaluator(metricName="mse"), -1)
    held = {r["__fold"] for r in rows.select("__fold").distinct().collect()}
    out = []
    for k in sorted(held) if len(held) > 1 else ():
        train, test = rows.where(F.col("__fold") != k), rows.where(F.col("__fold") == k)
        out.append(sign * judge.evaluate(forest(task, trees, depth).fit(train).transform(test)))
    return out


def impact(df: DataFrame, key: str, target: str, outliers: DataFrame, cols: Sequence[str] | None = None, folds: int = 5, trees: int = 50, depth: int = 10) -> DataFrame:
    """The cross-validated score of a forest with all rows and without the outliers (rows of :func:`detect`): data, n_rows, mean_score, std_score,
    and, on the second row, improvement and improvement_pct. The task is that of all rows; no rows give null scores."""
    cols = list(cols or columns_of(df, NUMERIC, but=(key, target)))
    task = infer_task(df, target)
    bad = outliers.where("is_outlier").select(F.col("row_key").alias("__key"))
    clean = df.join(bad, q(key) == F.col("__key"), "left_anti")
    lines, first, scores = [], None, None
    for name, rows in (("with_outliers", df), ("without_outliers", clean)):
        if scores is None or not bad.isEmpty():  # without outliers the same rows have the same scores
            scores = cv_scores(rows, cols, target, task, folds, trees, depth)
        mean = float(np.mean(scores)) if scores else None
        gain = mean - first if first is not None and mean is not None else None
        lines.append((name, rows.count(), mean, float(np.std(scores)) if scores else None, gain, gain / abs(first) * 100 if gain is not None and first else None))
        first = mean
    return df.sparkSession.createDataFrame(lines, "data string, n_rows long, mean_score double, std_score double, improvement double, improvement_pct double")
