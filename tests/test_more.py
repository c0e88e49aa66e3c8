"""Normality, information, scores, transformers, tracking."""

import numpy as np
import pandas as pd
import pytest

from assaykit.operators import normality, scoring
from assaykit.tracking import Config, Experiment, fingerprint, timed
from assaykit.transformers import NormaliseMissing, QualityCheck, QualityError


@pytest.fixture(scope="module")
def two(spark):
    rng = np.random.default_rng(0)
    return spark.createDataFrame(pd.DataFrame({"k": range(600), "normal": rng.normal(size=600), "skewed": rng.exponential(size=600)}))


def test_normality(two):
    k2 = {r["feature"]: r["p_value"] for r in normality.dagostino(two, ["normal", "skewed"]).collect()}
    assert k2["normal"] > 0.05 > k2["skewed"]
    assert normality.anderson_darling(two, "normal").first()["a2"] < 0.75 < normality.anderson_darling(two, "skewed").first()["a2"]
    assert normality.shapiro(two, "normal", "k")["w"] > 0.99 and normality.shapiro(two, "skewed", "k")["p_value"] < 1e-6
    rng = np.random.default_rng(1)
    rejected = np.mean([normality.shapiro_wilk(rng.normal(size=50))[1] < 0.05 for _ in range(200)])
    assert 0.01 < rejected < 0.11
    assert normality.shapiro_wilk([1.0] * 20) == (1.0, 1.0)


def test_anderson_darling_matches_the_definition(two):
    from assaykit.functions.distributions import normal_cdf

    x = np.sort(two.toPandas()["skewed"].to_numpy())
    z = (x - x.mean()) / x.std(ddof=1)
    f = np.array([normal_cdf(v) for v in z])
    i = np.arange(1, len(x) + 1)
    want = -len(x) - np.mean((2 * i - 1) * (np.log(f) + np.log(np.maximum(1 - f[::-1], 1e-300))))
    assert normality.anderson_darling(two, "skewed").first()["a2"] == pytest.approx(want, rel=1e-6)


def test_neighbour_information_knows_a_bivariate_normal():
    rng = np.random.default_rng(1)
    x = rng.normal(size=1000)
    y = 0.8 * x + 0.6 * rng.normal(size=1000)
    assert normality.ksg_information(x, y) == pytest.approx(-0.5 * np.log(1 - 0.64), abs=0.1)
    assert normality.ksg_information(x, rng.normal(size=1000)) < 0.1


def test_scores():
    assert scoring.combined_importance({"a": 1.0, "b": 0.0}, {"a": 0.0}) == {"a": 0.5, "b": 0.0}
    assert scoring.feature_score(low_variance=True, importance=0.2) == 80 and scoring.table_score(True, 0, 0, 0, 0, 0, 0) == 100
    got = scoring.consensus({"x": ["a", "b"], "y": ["a"], "z": ["a", "c"]})
    assert got["selected"][0] == "a" and scoring.optimal_features({"x": ["a"], "y": ["a", "b"]}) == ["a"]
    assert scoring.components_for([0.5, 0.9], 0.8) == 2 and scoring.components_for([0.5], 0.8) is None
    assert scoring.classify_mechanism(0.5, 0.0, 0.5)[0] == "MCAR" and scoring.classify_mechanism(0.9, 0.0, 0.5)[0] == "MAR"
    assert len(scoring.reservoir(iter(range(100)), 10)) == 10
    assert scoring.reduction_score(10, 2, 3, True, True) == 100


def test_gaps_that_depend_on_another_column_are_predictable(spark):
    df = spark.range(400).selectExpr("cast(id % 100 as double) AS a", "CASE WHEN id % 100 > 70 THEN NULL ELSE 1.0D END AS b")
    assert scoring.gap_predictability(df, "b", ["a"])["balanced_accuracy"] > 0.9


def test_transformers(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert NormaliseMissing().transform(df).where("x is null").count() == 1
    assert QualityCheck(least=0.0).transform(df).count() == 2
    with pytest.raises(QualityError):
        QualityCheck(least=90.0).transform(df)


def test_tracking(spark, tmp_path):
    df = spark.range(10)
    assert fingerprint(df) == fingerprint(df.repartition(3)) != fingerprint(spark.range(11))
    assert Experiment("e", "d").save(str(tmp_path)).endswith(".json")
    c, d = Config(str(tmp_path / "c.json")), Config()
    c.set("drift.psi", 0.5)
    c.save()
    assert Config(str(tmp_path / "c.json")).get("drift.psi") == 0.5 and d.get("drift.psi") == 0.2 and d.get("no.such", 1) == 1
    f = timed(lambda: 1)
    assert f() == 1 and f.seconds >= 0


def test_impact_without_outliers_scores_once(spark, monkeypatch):
    from assaykit.operators import ensemble

    df = spark.range(200).selectExpr("id AS k", "cast(id % 17 as double) AS a", "cast(id % 5 as double) AS b", "cast(id % 17 > 8 as int) AS y")
    none = df.selectExpr("k AS row_key", "false AS is_outlier")
    calls, score = [], ensemble.cv_scores
    monkeypatch.setattr(ensemble, "cv_scores", lambda *a: calls.append(1) or score(*a))
    one, two = ensemble.impact(df, "k", "y", none, folds=2, trees=2, depth=2).orderBy("data").collect()
    assert len(calls) == 1 and one["n_rows"] == two["n_rows"] == 200 and one["mean_score"] == two["mean_score"]
    some = df.selectExpr("k AS row_key", "k < 20 AS is_outlier")
    assert ensemble.impact(df, "k", "y", some, folds=2, trees=2, depth=2).where("n_rows = 180").count() == 1 and len(calls) == 3


def test_costly_rows_are_dealt_to_all_cores(spark):
    from assaykit.operators.modelling import dealt_to_cores, isolation_forest

    cores, one = spark.sparkContext.defaultParallelism, spark.range(100).coalesce(1)
    assert dealt_to_cores(one).rdd.getNumPartitions() == cores and dealt_to_cores(one).count() == 100
    many = spark.range(100).repartition(cores + 3)
    assert dealt_to_cores(many).rdd.getNumPartitions() == cores + 3
    got = isolation_forest(one.selectExpr("id AS k", "cast(id % 7 as double) AS a", "cast(id * id as double) AS b"), "k", ["a", "b"], trees=5)
    assert got.count() == 100 and got.rdd.getNumPartitions() >= cores
