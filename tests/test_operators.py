"""Operators on small tables: edge cases, known answers, planted issues."""

import math

import numpy as np
import pandas as pd
import pytest

from assaykit import benchmarks, reports
from assaykit.columns import infer_task, normalise_missing
from assaykit.functions import distributions as dist
from assaykit.operators import drift, fairness, features, gate, leakage, missing, modelling, neighbours, outlier, profile, sampling, timeseries
from assaykit.pipeline import Pipeline, quick_analyze
from assaykit.plans.ordering import blocked, numbered
from assaykit.sources import loader


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_missing_counts_treat_nan_as_null(spark):
    df = normalise_missing(frame(spark, [(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string"))
    got = {r["feature"]: r["n_missing"] for r in missing.by_column(df).collect()}
    assert got == {"x": 2, "s": 1}


def test_all_missing_column_is_left_out_of_the_summary(spark):
    df = frame(spark, [(1, None), (2, None)], "a int, b double")
    assert [r["feature"] for r in profile.numeric_summary(df).collect()] == ["a"]


def test_summary_matches_pandas(spark):
    x = pd.Series(np.random.default_rng(1).exponential(size=200))
    r = profile.numeric_summary(spark.createDataFrame(pd.DataFrame({"x": x}))).first()
    for name, want in {"mean": x.mean(), "std": x.std(), "median": x.median(), "skew": x.skew(), "kurtosis": x.kurt(), "q25": x.quantile(0.25)}.items():
        assert r[name] == pytest.approx(want, rel=1e-9)


def test_constant_columns_have_no_correlation_and_zero_skew(spark):
    df = frame(spark, [(1.0, float(i)) for i in range(10)], "c double, x double")
    assert profile.correlations(df, ["c", "x"]).count() == 0
    assert {r["feature"]: r["skew"] for r in profile.numeric_summary(df).collect()}["c"] == 0.0


def test_empty_tables_give_empty_or_zero_results(spark):
    df = frame(spark, [], "a double, b string")
    assert missing.by_column(df).first()["missing_pct"] == 0.0
    assert profile.numeric_summary(df).count() == 0
    assert profile.class_balance(df, "b").count() == 0
    assert leakage.contamination(df, df).first()["n_contaminated"] == 0


def test_contamination_and_groups(spark):
    train = frame(spark, [(i, i * 0.5) for i in range(50)], "id int, x double")
    test = frame(spark, [(i + 1000, i * 0.5) for i in range(5)] + [(2000 + i, 1e6 + i) for i in range(5)], "id int, x double")
    assert leakage.contamination(train, test).first()["n_contaminated"] == 0
    assert leakage.contamination(train, test, exclude=["id"]).first()["n_contaminated"] == 5
    overlap = leakage.group_overlap(frame(spark, [(i,) for i in range(1, 51)], "c int"), frame(spark, [(i,) for i in range(40, 60)], "c int"), "c").first()
    assert (overlap["n_overlap"], round(overlap["overlap_pct"], 6), overlap["severity"]) == (11, 55.0, "critical")


def test_outlier_votes_and_context(spark):
    rows = [(i, "g", float(i % 7)) for i in range(60)] + [(99, "g", 500.0), (100, "small", 3.0)]
    df = frame(spark, rows, "k int, g string, x double")
    assert [r["k"] for r in outlier.consensus(df, ["k"], ["x"]).where("is_outlier").collect()] == [99]
    assert {r["context"]: r["n_outliers"] for r in outlier.by_context(df, ["x"], "g").collect()} == {"g": 1}


def test_drift_of_equal_sides_is_nothing_and_of_shifted_sides_is_large(spark):
    a = spark.range(2000).selectExpr("cast(id % 100 as double) AS x", "cast(id % 3 as string) AS v")
    b = a.selectExpr("x + 60 AS x", "CASE WHEN v = '0' THEN 'new' ELSE v END AS v")
    same, moved = drift.analyze(a, a, ["x"], ["v"]), drift.analyze(a, b, ["x"], ["v"])
    assert same["severity"] == "none" and same["features"]["x"]["psi"] == pytest.approx(0, abs=1e-9)
    assert moved["features"]["x"]["psi"] > 0.2 and moved["features"]["v"]["new_categories"] == ["new"]
    assert moved["overall_score"] > 50


def test_fair_rates_with_a_positive_class(spark):
    df = frame(spark, [("a", 1)] * 8 + [("a", 0)] * 2 + [("b", 1)] * 2 + [("b", 0)] * 8, "g string, y int")
    own = {r["group"]: r["positive_rate"] for r in fairness.group_rates(df, "g", "y").collect()}
    fixed = {r["group"]: r["positive_rate"] for r in fairness.group_rates(df, "g", "y", "1").collect()}
    assert own == {"a": 0.8, "b": 0.8} and fixed == {"a": 0.8, "b": 0.2}


def test_numbering_and_blocks_are_exact_across_block_borders(spark):
    df = spark.range(0, 1000).selectExpr("(id * 7919) % 1000 AS k").repartition(7)
    n = numbered(df, ["k"])
    assert n.where("k <> __rn").count() == 0
    from pyspark.sql import functions as F

    dealt, w = blocked(n, before=3, after=2, block=64)
    got = dealt.select("k", "__own", F.lag("k", 3).over(w).alias("b"), F.lead("k", 2).over(w).alias("f")).where("__own")
    assert got.count() == 1000
    assert got.where("b is not null and b <> k - 3 or f is not null and f <> k + 2").count() == 0
    assert got.where("b is null").count() == 3 and got.where("f is null").count() == 2


def test_rolling_and_ewm_match_pandas(spark):
    x = pd.Series(np.random.default_rng(3).normal(size=100))
    x[[4, 50]] = np.nan
    df = normalise_missing(spark.createDataFrame(pd.DataFrame({"i": range(100), "x": x})))
    got = timeseries.ewm_mean(df, "x", ["i"]).orderBy("i").toPandas()["ewm"]
    np.testing.assert_allclose(got, x.ewm(span=7).mean(), rtol=1e-9)
    roll = timeseries.rolling_features(df, "x", ["i"], [7]).orderBy("i").toPandas()
    np.testing.assert_allclose(roll["mean_7"], x.rolling(7, min_periods=1).mean(), rtol=1e-9)
    lag = timeseries.lag_features(df, "x", ["i"], [1]).orderBy("i").toPandas()
    assert math.isnan(lag["pct_change"][0]) and lag["pct_change"][4] == pytest.approx(0.0)


def test_samples(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 10 = 0 as int) AS s", "cast(id as double) AS w")
    assert sampling.random_rows(df, ["id"], 50).count() == 50
    assert {r["s"]: r["count"] for r in sampling.stratified(df, "s", ["id"], 0.1).groupBy("s").count().collect()} == {0: 90, 1: 10}
    assert sampling.systematic(df, ["id"], 100, 5).count() == 10
    assert sampling.weighted(df, ["id"], "w", 100).agg({"w": "avg"}).first()[0] > 550


def test_gate_and_alerts():
    g = gate.QualityGate().add_check("a", "gte", 1).add_check("b", "lt", 5, "warning").add_check("c", "eq", 0)
    assert g.evaluate({"a": 2, "b": 9})["passed"] and not g.evaluate({"a": 0})["passed"]
    m = gate.AlertManager(window_minutes=10)
    m.channels.append(gate.SlackChannel("http://localhost"))
    m.add_threshold("x", "gt", 1)
    assert len(m.check({"x": 2}, now=0)) == 1 and not m.check({"x": 2}, now=60) and len(m.check({"x": 2}, now=3600)) == 1
    assert m.summary()["by_category"] == {"quality": 2}
    assert gate.ci_check(99, 1, 0)[1] == 0 and gate.ci_check(50, 1, 0, "github")[1] == 1


def test_tail_probabilities():
    assert dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.t_two_sided(2.085963, 20) == pytest.approx(0.05, abs=1e-6)
    assert dist.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.ks_sf(0.0, 10, 10) == 1.0 and dist.ks_sf(1.0, 100, 100) < 1e-20
    assert dist.normal_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)


def test_encoders_and_scalers(spark):
    df = frame(spark, [(i, f"v{i % 12}", float(i)) for i in range(60)] + [(60, None, None)], "k int, c string, x double")
    assert len([c for c in features.one_hot(df, "c").columns if c.startswith("c=")]) == 10
    assert features.ordinal(df, "c").where("k = 60").first()["c_code"] == -1
    z = features.scaled(df, ["x"], "minmax").agg({"x_minmax": "max"}).first()[0]
    assert z == 1.0
    flat = frame(spark, [(5.0,), (5.0,)], "x double")
    assert {r["x_zscore"] for r in features.scaled(flat, ["x"]).collect()} == {0.0}


def test_yeo_johnson_makes_an_exponential_sample_less_skewed(spark):
    x = np.random.default_rng(0).exponential(size=500)
    df = features.yeo_johnson(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"]).toPandas()
    assert abs(df["x_yj"].skew()) < 0.3 < abs(df["x"].skew())


def test_synthetic_issues_are_found(spark):
    df, truth = benchmarks.table(spark, "duplicates")
    cols = [c for c in df.columns if c not in ("target", "row_id")]
    found = {(r["feature_1"], r["feature_2"]) for r in leakage.duplicate_numeric(df, cols).collect()}
    assert benchmarks.score(found, set(truth["pairs"]))["f1"] == 1.0
    df, truth = benchmarks.table(spark, "mcar")
    found = {r["feature"] for r in missing.by_column(df).where("n_missing > 0").collect()}
    assert benchmarks.score(found, set(truth["missing_columns"]))["recall"] == 1.0
    df, truth = benchmarks.table(spark, "outliers")
    got = {r["row_id"] for r in outlier.consensus(df, ["row_id"], ["feature_0"]).where("by_zscore").collect()}
    assert benchmarks.score(got, set(truth["rows"]))["recall"] >= 0.9
    df, truth = benchmarks.table(spark, "perfect_corr")
    cols = [c for c in df.columns if c not in ("target", "row_id")]
    found = {(r["feature_1"], r["feature_2"]) for r in leakage.perfect_correlations(df, cols).collect()}
    assert set(truth["pairs"]) <= found
    for name in ("mar", "mnar", "temporal", "imbalance", "contamination", "mixed"):
        assert len(benchmarks.generate(name)[0])


def test_anomaly_models_rank_planted_rows_first(spark):
    rng = np.random.default_rng(5)
    x = pd.DataFrame(rng.normal(size=(300, 2)), columns=["a", "b"])
    x.loc[:4, ["a", "b"]] = [[9, 9], [-9, 9], [9, -9], [-9, -9], [12, 0]]
    df = spark.createDataFrame(x.assign(k=range(300)))
    for model in (modelling.isolation_forest, neighbours.local_outliers):
        top = [r["row_key"] for r in model(df, "k", ["a", "b"]).orderBy("score", ascending=False).limit(5).collect()]
        assert set(top) == set(range(5)), model.__name__
    noise = {r["row_key"] for r in modelling.dbscan(df, "k", ["a", "b"]).where("is_noise").collect()}
    assert set(range(5)) <= noise


def test_dbscan_agrees_with_a_plain_one(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.3, (60, 2)), rng.normal(4, 0.3, (60, 2)), rng.uniform(-3, 8, (20, 2))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(k=range(140)))
    z = (x - x.mean(0)) / x.std(0)
    near = np.square(z[:, None] - z[None]).sum(-1) <= 0.25
    core = near.sum(1) >= 5
    noise = ~core & ~(near & core[None]).any(1)
    got = modelling.dbscan(df, "k", ["a", "b"]).orderBy("row_key").toPandas()
    assert (got["is_core"].to_numpy() == core).all() and (got["is_noise"].to_numpy() == noise).all()
    label = np.arange(140)
    for _ in range(140):
        label = np.array([min(label[j] for j in np.flatnonzero(near[i] & core)) if core[i] else label[i] for i in range(140)])
    assert pd.DataFrame({"a": label[core], "b": got["cluster"][core]}).drop_duplicates().groupby("a").size().max() == 1
    assert len(set(label[core])) == got["cluster"][core].nunique()


def test_knn_fill_uses_near_donors(spark):
    df = frame(spark, [(i, float(i), float(2 * i)) for i in range(20)] + [(100, 10.0, None)], "k int, a double, b double")
    assert neighbours.knn_impute(df, "k", ["a", "b"], 3).where("k = 100").first()["b"] == pytest.approx(20.0)


def test_shapley_values_add_up(spark):
    x = pd.DataFrame(np.random.default_rng(0).normal(size=(60, 2)), columns=["a", "b"])
    df = spark.createDataFrame(x.assign(k=range(60), y=3 * x.a))
    s = modelling.shap_values(df, "k", ["a", "b"], "y", permutations=2, background=20, trees=5)
    by = {r["feature"]: r["mean_abs_shap"] for r in modelling.shap_summary(s).collect()}
    assert by["a"] > 5 * by["b"]


def test_loader_formats_and_json_envelopes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name\n1,caf\xe9\n2,b\n".encode("iso-8859-1"))
    df = loader.load(spark, f"{tmp_path}/a.csv")
    assert df.count() == 2 and df.where("id = 1").first()["name"] == "café"
    (tmp_path / "e.json").write_text('{"data": [{"x": 1}, {"x": 2}]}')
    assert loader.load(spark, f"{tmp_path}/e.json").agg({"x": "sum"}).first()[0] == 3
    with pytest.raises(loader.UnsupportedFormat):
        loader.load(spark, "a.pkl")
    assert loader.plain({"a": float("nan"), "b": np.int64(3)}) == {"a": None, "b": 3}
    chunks = loader.process_in_chunks(spark.range(100).repartition(2), lambda p: pd.DataFrame({"n": [len(p)]}), "n long")
    assert chunks.agg({"n": "sum"}).first()[0] == 100


def test_pipeline_runs_all_steps_and_exports(spark, tmp_path):
    df, _ = benchmarks.table(spark, "mixed")
    df = df.select("row_id", "feature_0", "feature_3", "dup_feature", "constant_feature", "target")
    out = quick_analyze(df, "target")
    assert not out.errors and out.steps["leakage_detection"]["duplicates"]
    p = Pipeline().add_step("completeness").add_step("fairness")
    assert "fairness" in p.run(df).errors
    for style in ("json", "html", "text"):
        p.export(str(tmp_path / style), style)
    assert reports.grade(95) == "A" and "## Use" in reports.model_card("m", {"Use": ["x"]})
    assert infer_task(df, "target") == "classification"


def test_stream_profile_equals_batch(spark, tmp_path):
    from assaykit.streaming import monitor

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "value", "event_type")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = monitor.profile(stream, "ts", ["value"], "1 day").writeStream.outputMode("complete").format("memory").queryName("prof").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    got = {r["window_start"]: r["n_rows"] for r in spark.table("prof").collect()}
    assert got == {r["window_start"]: r["n_rows"] for r in monitor.profile(src, "ts", ["value"], "1 day").collect()}
    assert monitor.sessions(src, "ts", "event_type").count() > 0


def test_dbscan_keeps_a_long_chain_whole(spark):
    chain = pd.DataFrame({"a": np.arange(600.0), "b": np.zeros(600), "k": range(600)})
    df, step = spark.createDataFrame(chain), 1 / chain["a"].std()
    got = modelling.dbscan(df, "k", ["a"], 1.5 * step, 3)
    assert got.where("is_core").select("cluster").distinct().count() == 1 and got.where("is_noise").count() == 0


def test_permuted_rows_keep_their_values(spark):
    df = spark.range(500).selectExpr("cast(id as double) AS a", "cast(id % 7 as double) AS b", "cast(id % 2 as int) AS y").repartition(3)
    got = modelling.permuted(df, ["a", "b"], 3).toPandas()
    assert sorted(got["__p_a"]) == sorted(got["a"]) and sorted(got["__p_b"]) == sorted(got["b"])
    assert (got["__p_a"] != got["a"]).mean() > 0.9 and abs(np.corrcoef(got["a"], got["__p_a"])[0, 1]) < 0.2
    again = modelling.permuted(df.repartition(5), ["a", "b"], 3).toPandas().sort_values("a")
    assert (again["__p_a"].to_numpy() == got.sort_values("a")["__p_a"].to_numpy()).all()


def test_leakage_findings(spark):
    rows = [(i, float(i % 50), float(2 * (i % 50)), f"c{i % 50}", i % 40) for i in range(400)]
    train = spark.createDataFrame(rows, "id int, y double, twice double, code string, who int")
    test = spark.createDataFrame([*rows[:5], *((1000 + i, float(i % 50), 500.0 + i, f"d{i}", 100 + i) for i in range(200))], train.schema)
    found = leakage.detect_all(train, test, "y", "who")
    by = {(r["type"], *r["features"]): r["severity"] for r in found.collect()}
    assert by["train_test_contamination",] == "critical" and by["target_leakage", "twice"] == "critical" and by["group_leakage", "who"] == "medium"
    assert ("perfect_predictor", "code") in by and ("perfect_predictor", "id") not in by
    assert any(k[0] == "distribution_shift" and "twice" in k for k in by)
    r = leakage.severity_counts(found).first()
    assert r["total"] == len(by) and r["critical"] == sum(v == "critical" for v in by.values())
    assert leakage.detect_all(train.where("id < 0"), test.where("id < 0"), "y", "who").count() == 0


def test_votes_and_removal(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame(pd.DataFrame({"good": x[:, 0], "same": x[:, 0] * 2, "noise": x[:, 1], "flat": 1.0, "y": (x[:, 0] > 0).astype(int)}))
    got = {r["feature"]: r for r in modelling.select_features(df, ["good", "same", "noise", "flat"], "y", ["variance", "correlation", "lasso"]).collect()}
    assert "variance" not in got["flat"]["methods"] and "correlation" not in got["same"]["methods"] and got["good"]["votes"] == 3 and got["good"]["selected"]
    with pytest.raises(ValueError, match="unknown methods"):
        modelling.select_features(df, ["good"], "y", ["magic"])
    got = {r["feature"]: r for r in modelling.removal_impact(df, ["good", "noise"], "y", ["good", "noise", "absent"], folds=3, trees=5).collect()}
    assert got["good"]["verdict"] == "likely leakage" and got["noise"]["verdict"] == "probably fine" and len(got) == 2
