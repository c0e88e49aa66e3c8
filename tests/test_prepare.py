"""Preparation, the ensemble of outlier detectors and the leakage report."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaykit.operators import ensemble, leakage_report, neighbours, outlier, prepare


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    n = 200
    rows = [
        (f"u{i:06d}-x", float(rng.normal()) if i % 9 else None, f"${rng.integers(1, 9)},{rng.integers(100, 999)}" if i != 5 else "n/a", "abc"[i % 3] if i % 11 else None, f"2024-0{1 + i % 9}-1{i % 8}", "a long sentence that goes on and on, number " + str(i) + " of a great many of them", None, f"v{i % 14:02d}", i % 2)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "code string, a double, cash string, kind string, day string, note string, none string, many string, y int")


def test_types_are_found_from_all_values(table):
    t = prepare.infer_types(table.drop("y"))
    assert t.numeric == ["a", "cash"] and t.datetime == ["day"] and t.text == ["note"] and t.categorical == ["code", "kind", "none", "many"]
    assert t.converted == {"cash": "numeric", "day": "datetime"} and "code" in t.ids and "kind" not in t.ids


def test_preparation_fills_codes_scales_and_serves_new_rows(spark, table):
    p = prepare.setup(table, "y", normalize="zscore", ignore=["none", "day"])
    got = p.transform(table).toPandas()
    raw = table.toPandas()
    a = raw["a"].fillna(raw["a"].mean())
    cash = pd.to_numeric(raw["cash"].str.replace(r"[,$]", "", regex=True), errors="coerce")
    cash = cash.fillna(cash.mean())
    assert np.allclose(got["num_a"], (a - a.mean()) / a.std(ddof=0)) and np.allclose(got["num_cash"], (cash - cash.mean()) / cash.std(ddof=0))
    kind = raw["kind"].fillna(raw["kind"].value_counts().sort_index().idxmax())
    assert all((got[f"cat_kind_{v}"] == (kind == v)).all() for v in "abc") and "cat_kind_other" not in got
    assert sum(c.startswith("cat_many") for c in got) == 10 and got.filter(like="cat_many").sum(1).eq(1).all() and "note" not in got and got["y"].tolist() == raw["y"].tolist()
    new = spark.createDataFrame([(None, None, "7", "zzz", None, None, None, "v99", None)], table.schema)
    r = p.transform(new).first()
    assert r["num_a"] == pytest.approx(0, abs=1e-9) and r["cat_kind_a"] == r["cat_kind_b"] == 0.0 and r["cat_many_other"] == 1.0
    m = p.metadata()
    assert m["numeric_columns"] == ["a", "cash"] and m["text_columns"] == ["note"] and "code" in m["id_like_columns"] and m["target"] == "y"


@pytest.mark.parametrize("fill", ["median", "most_frequent", 4.5])
def test_fills(table, fill):
    p = prepare.setup(table, "y", numeric=["a"], categorical=["kind"], datetime=[], numeric_fill=fill, categorical_fill="gap", encoding="ordinal")
    a = table.toPandas()["a"]
    assert p.fills["a"] == pytest.approx(4.5 if fill == 4.5 else a.median() if fill == "median" else a.dropna().min()) and p.categories["kind"] == ["a", "b", "c", "gap"]
    assert set(p.transform(table).toPandas()["cat_kind"]) == {0.0, 1.0, 2.0, 3.0}
    with pytest.raises(ValueError, match="unknown"):
        prepare.setup(table, normalize="magic")


def test_normal_scores(spark):
    p = [0.0, 1e-6, 0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 1.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(prepare.normal_score(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(min(max(x, prepare.EDGE), 1 - prepare.EDGE)) for x in p], atol=1e-7)


@pytest.mark.parametrize("method", ["yeo-johnson", "quantile-normal", "quantile-uniform"])
def test_transforms(spark, method):
    x = np.random.default_rng(8).exponential(size=500)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    got = prepare.setup(df, numeric=["x"], ignore=["i"], transformation=method).transform(df, ["i"]).toPandas().sort_values("i")["num_x"].to_numpy()
    assert (np.argsort(got, kind="stable") == np.argsort(x, kind="stable")).mean() > 0.97 and np.isfinite(got).all()
    if method == "quantile-uniform":
        assert np.allclose(np.sort(got), np.linspace(0, 1, 500), atol=2e-3)
    else:
        inner = got[(x > np.quantile(x, 0.01)) & (x < np.quantile(x, 0.99))]
        assert abs(pd.Series(inner).skew()) < 0.25 and abs(np.median(got)) < 0.15


def test_components_are_principal(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3)) @ np.array([[2, 1, 0], [0, 1, 0.5], [0, 0, 0.2]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(k=range(300)))
    p = prepare.setup(df, numeric=list("abc"), ignore=["k"], components=0.2)
    got = p.transform(df, ["k"]).toPandas().sort_values("k")[["pc_1", "pc_2"]].to_numpy()
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6) and p.metadata()["components"] == 2


def test_preparation_of_empty_tables_and_columns(table):
    p = prepare.setup(table.limit(0), "y", numeric=["a"], categorical=["kind"], datetime=["day"], normalize="robust", transformation="quantile-normal")
    assert p.transform(table.limit(0)).count() == 0 and p.fills == {"a": 0.0, "kind": "missing"}
    assert prepare.setup(table, "y", numeric=[], categorical=["none"], datetime=[]).fills == {"none": "missing"}


def test_detectors_vote_and_the_guard_holds(spark):
    rng = np.random.default_rng(10)
    x = pd.DataFrame(rng.normal(size=(150, 2)), columns=["a", "b"])
    x.loc[:2, ["a", "b"]] = [[8, 8], [-9, 9], [9, -9]]
    x.loc[140:, "b"] = np.nan
    df = spark.createDataFrame(x.assign(k=range(150), g="one"))
    df = df.withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    got = ensemble.detect(df, "k", ["a", "b"], context="g")
    rows = got["rows"].toPandas().sort_values("row_key").reset_index(drop=True)
    lof = neighbours.local_outliers(df, "k", ["a", "b"]).toPandas().sort_values("row_key")
    assert (rows["by_lof"].to_numpy() == lof["is_outlier"].to_numpy()).all()
    two = outlier.consensus(df, ["k"], ["a", "b"]).toPandas().sort_values("k")
    assert (rows["by_iqr"].to_numpy() == two["by_iqr"].to_numpy()).all() and (rows["by_zscore"].to_numpy() == two["by_zscore"].to_numpy()).all()
    assert (rows["votes"] == rows.filter(like="by_").sum(1)).all() and (rows["is_outlier"] == (rows["votes"] >= 2)).all() and rows["is_outlier"][:3].all()
    assert got["summary"]["outliers"] == rows["is_outlier"].sum() and got["contextual"].count() == 2 and got["by_column"].count() == 2
    few = ensemble.detect(df.where("k < 9"), "k", ["a", "b"])
    assert few["rows"].where("is_outlier").count() == 0 and few["by_method"].where("error is null").count() == 0 and few["summary"]["rows"] == 9
    with pytest.raises(ValueError, match="unknown methods"):
        ensemble.detect(df, "k", ["a"], ["magic"])


def test_impact_of_leaving_outliers_out(spark):
    rng = np.random.default_rng(11)
    a = rng.normal(size=160)
    y = 3 * a + 0.1 * rng.normal(size=160)
    y[:6] = 80.0
    df = spark.createDataFrame(pd.DataFrame({"k": range(160), "a": a, "y": y}))
    bad = df.select(F.col("k").alias("row_key"), (F.col("k") < 6).alias("is_outlier"))
    first, second = ensemble.impact(df, "k", "y", bad, folds=3, trees=5, depth=4).collect()
    assert (first["n_rows"], second["n_rows"]) == (160, 154) and first["improvement"] is None
    assert second["improvement"] == pytest.approx(second["mean_score"] - first["mean_score"]) and second["improvement"] > 10 and first["mean_score"] < 0


def test_leakage_report_of_a_table(spark):
    rng = np.random.default_rng(12)
    n = 120
    rows = [(i, float(v := rng.normal()), 2.0 * v, float(rng.normal()), "ab"[i % 2], "xy"[i % 2], f"20{20 + 30 * (i == 3)}-01-01", 1, i % 2) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, a double, twice double, noise double, kind string, outcome string, day string, flat int, y int")
    got = leakage_report.table_report(df, "y", "2024-06-01")
    found = {(r["kind"], r["feature"]): r for r in got["findings"].collect()}
    assert ("perfect_correlation", "a") in found and ("duplicate", "a") in found and ("constant", "flat") in found
    assert {f for k, f in found if k == "perfect_predictor"} == {"kind", "outcome"} and found["suspicious_name", "outcome"]["severity"] == "Medium"
    assert found["temporal", "day"]["severity"] == "Critical" and found["temporal", "day"]["value"] == pytest.approx(100 / n)
    assert not any(f == "noise" for _, f in found) and not any(f == "k" and k == "perfect_predictor" for k, f in found)
    assert got["target"]["classes"] == {"0": 60, "1": 60} and 0 < got["score"] <= 100 and got["recommendations"][0].startswith("Correct or drop times")
    clean = leakage_report.table_report(df.select("k", "a", "noise"), None, "2024-06-01")
    assert clean["score"] == 0 and clean["recommendations"] == ["No leakage was found."] and clean["findings"].count() == 0
    assert leakage_report.table_report(df.limit(0), "y", "2024-06-01")["target"]["n"] == 0
    assert math.isfinite(leakage_report.table_report(df, "a", "2024-06-01")["score"])
