"""Synthetic tables with known issues, and the scoring of detections against them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .columns import normalise_missing


def _base(n: int, k: int, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k))
    df = pd.DataFrame(x, columns=[f"feature_{i}" for i in range(k)])
    df["target"] = (x[:, :3].sum(1) + rng.normal(0, 0.5, n) > 0).astype(int)
    return df


def generate(name: str) -> tuple[pd.DataFrame, dict]:
    """The table and its ground truth. Names: mcar, mar, mnar, perfect_corr, temporal, outliers, imbalance, duplicates, contamination, mixed."""
    names = ["mcar", "mar", "mnar", "perfect_corr", "temporal", "outliers", "imbalance", "duplicates", "contamination", "mixed"]
    seed = 42 + names.index(name)
    rng = np.random.default_rng(seed)
    df = _base(2000 if name == "imbalance" else 1500 if name == "mixed" else 1000, 20, seed)
    f = [c for c in df if c != "target"]
    n, truth = len(df), {}
    if name == "mcar":
        gaps = rng.random((n, len(f))) < 0.1
        df[f] = df[f].mask(gaps)
        truth = {"missing_columns": f, "mechanism": "MCAR"}
    elif name == "mar":
        df.loc[(df.feature_0 > df.feature_0.median()) & (rng.random(n) < 0.3), "feature_5"] = np.nan
        df.loc[(df.feature_1 < df.feature_1.median()) & (rng.random(n) < 0.25), "feature_10"] = np.nan
        truth = {"missing_columns": ["feature_5", "feature_10"], "mechanism": "MAR"}
    elif name == "mnar":
        df.loc[(df.feature_3 > df.feature_3.quantile(0.9)) & (rng.random(n) < 0.7), "feature_3"] = np.nan
        out = (df.feature_8 < df.feature_8.quantile(0.1)) | (df.feature_8 > df.feature_8.quantile(0.9))
        df.loc[out & (rng.random(n) < 0.5), "feature_8"] = np.nan
        truth = {"missing_columns": ["feature_3", "feature_8"], "mechanism": "MNAR"}
    elif name == "perfect_corr":
        df["leak_1"], df["leak_2"], df["leak_3"] = df.feature_0, df.feature_1 + rng.normal(0, 0.01, n), df.feature_2 + df.feature_3
        df["leak_4"], df["leak_5"] = -df.feature_4, 2 * df.feature_5 + 3
        truth = {"pairs": [("feature_0", "leak_1"), ("feature_1", "leak_2"), ("feature_4", "leak_4"), ("feature_5", "leak_5")]}
    elif name == "temporal":
        v = pd.Series(np.cumsum(rng.normal(size=n)))
        df = pd.DataFrame({"date": pd.date_range("2020-01-01", periods=n), "feature_1": rng.normal(size=n), "value": v, "leak_next_day": v.shift(-1)}).dropna()
        truth = {"leaks": ["leak_next_day"]}
    elif name == "outliers":
        rows = rng.choice(n, 50, replace=False)
        df.loc[rows, "feature_0"] = 8 * rng.choice([-1, 1], 50)
        truth = {"rows": sorted(int(r) for r in rows), "column": "feature_0"}
    elif name == "imbalance":
        df["target"] = (rng.random(n) < 0.05).astype(int)
        truth = {"ratio": 19.0}
    elif name == "duplicates":
        df["dup_exact_1"], df["dup_exact_2"], df["dup_near_1"] = df.feature_0, df.feature_1, df.feature_2 + rng.normal(0, 0.01, n)
        truth = {"pairs": [("feature_0", "dup_exact_1"), ("feature_1", "dup_exact_2"), ("feature_2", "dup_near_1")]}
    elif name == "contamination":
        df["leak_direct"], df["leak_subtle"] = df.target, df.target + rng.normal(0, 0.3, n)
        truth = {"leaks": ["leak_direct"]}
    else:
        df["constant_feature"], df["dup_feature"] = 1, df.feature_0
        for c in ("feature_3", "feature_7", "feature_9"):
            df.loc[rng.random(n) < 0.08, c] = np.nan
        truth = {"missing_columns": ["feature_3", "feature_7", "feature_9"], "constant": ["constant_feature"], "pairs": [("feature_0", "dup_feature")]}
    df.insert(0, "row_id", range(len(df)))
    return df, truth


def table(spark: SparkSession, name: str) -> tuple[DataFrame, dict]:
    df, truth = generate(name)
    return normalise_missing(spark.createDataFrame(df)), truth


def score(found: set, true: set) -> dict[str, float]:
    """Precision, recall and F1 of what was found."""
    hit = len(found & true)
    p, r = hit / len(found) if found else 0.0, hit / len(true) if true else 1.0
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0}
