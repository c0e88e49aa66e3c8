"""Order statistics from counts against numpy."""

import numpy as np
import pandas as pd
import pytest

from assaykit.operators import features, missing, profile
from assaykit.plans.ranks import Histogram, exact_quantiles, medians

POINTS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 5_000
    df = pd.DataFrame({"a": rng.normal(size=n).round(2), "b": np.where(rng.random(n) < 0.5, 7.0, rng.integers(0, 50, n)), "g": rng.choice(["x", "y", "z"], n)})
    df.loc[rng.random(n) < 0.2, "a"] = None
    df["none"] = np.nan
    return df.astype(object).where(df.notna(), None)


@pytest.fixture(scope="module")
def table(spark, frame):
    return spark.createDataFrame(frame.values.tolist(), "a double, b double, g string, none double").repartition(7)


def test_quantiles_equal_numpy(frame, table):
    got = exact_quantiles(table, ["a", "b", "none"], POINTS)
    for c in ("a", "b"):
        assert np.allclose(got[c], np.quantile(frame[c].dropna().astype(float), POINTS))
    assert got["none"] == [None] * len(POINTS) and medians(table.limit(0), ["a"]) == {"a": None}


def test_quantiles_by_group_take_null_groups(frame, table, spark):
    both = table.unionByName(spark.createDataFrame([(1.0, 2.0, None, None), (3.0, 2.0, None, None)], table.schema))
    got = {(r["g"], r["feature"]): r for r in Histogram(both, ["a", "b"], ["g"]).quantiles([0.5]).collect()}
    for g, part in frame.groupby("g"):
        assert np.isclose(got[g, "a"]["at"][0], part.a.dropna().astype(float).median()) and got[g, "b"]["n"] == len(part)
    assert got[None, "a"]["at"] == [2.0]
    assert {(r["g"], r["feature"]): r["mode"] for r in Histogram(both, ["b"], ["g"]).modes().collect()} == {(g, "b"): 7.0 if g else 2.0 for g in ("x", "y", "z", None)}
    assert profile.numeric_summary(both, ["a", "b"], ["g"]).count() == 8


def test_medians_of_filled_columns(frame, table):
    got = {(r["feature"], r["method"]): r for r in missing.imputation_impact(table, ["a", "b", "none"]).collect()}
    a = frame.a.astype(float)
    for m, v in {"mean": a.mean(), "median": a.median(), "mode": a.mode()[0]}.items():
        assert np.isclose(got["a", m]["fill"], v) and np.isclose(got["a", m]["median_delta"], a.fillna(v).median() - a.median(), atol=1e-12)
    assert got["none", "mean"]["median_delta"] is None


@pytest.mark.parametrize("fill", [-10.0, -0.005, 0.0, 0.4, 10.0])
def test_median_after_any_fill(frame, table, fill):
    a = frame.a.astype(float)
    got = Histogram(table, ["a"]).filled_medians({"a": {"m": fill}}, {"a": int(a.isna().sum())})
    assert np.isclose(got["a", "m"], a.fillna(fill).median())


def test_codes_and_group_means_take_nulls(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, 3.0), ("b", 3.0)], "k string, v double")
    assert sorted((r["k"] or "", r["k_code"]) for r in features.ordinal(df, "k").collect()) == [("", -1), ("a", 0), ("b", 1), ("b", 1)]
    assert sorted((r["k"] or "", r["group_mean"]) for r in features.group_mean(df, "k", "v").collect()) == [("", 3.0), ("a", 2.0), ("b", 2.0), ("b", 2.0)]
    with pytest.raises(ValueError):
        features.frequent(df, "k")
