"""User models, elimination, support vectors, neighbours as a model; mergeable aggregates, partitioned reads, exact distributions."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaykit.functions import distributions as dist
from assaykit.operators import models
from assaykit.sources import loader


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = pd.DataFrame(rng.normal(size=(240, 4)), columns=list("abcd"))
    return spark.createDataFrame(x.assign(k=range(240), y=3 * x.a - x.b + 0.2 * rng.normal(size=240), two=(x.a + 0.3 * rng.normal(size=240) > 0) * 1)).cache()


def toy():
    class Toy:  # sent by value, as a class of a user's notebook is
        def predict(self, x):
            return x[:, 0] * 2 + x[:, 1]

        def predict_proba(self, x):
            p = 1 / (1 + np.exp(-x[:, 0]))
            return np.column_stack([1 - p, p])

    return Toy()


def test_user_models_in_plans(spark, data):
    gaps = data.withColumn("b", F.when(F.col("k") % 5 > 0, F.col("b")))
    out = models.with_predictions(models.with_predictions(gaps, ["a", "b"], toy()), ["a"], toy(), "p", 2).toPandas()
    want = 2 * out["a"] + out["b"].fillna(out["b"].median())
    assert out.columns.tolist() == [*data.columns, "prediction", "p"] and np.allclose(out["prediction"], want)
    assert np.allclose([v[1] for v in out["p"]], 1 / (1 + np.exp(-out["a"])))
    assert models.with_predictions(data.limit(0), ["a", "b"], toy()).count() == 0
    by = {r["feature"]: r["importance"] for r in models.model_importance(data.withColumn("y", 2 * F.col("a") + F.col("b")), ["a", "b"], "y", toy(), 2).collect()}
    assert by["a"] > by["b"] > 0.1


def test_elimination_chooses_the_size_of_the_best_mean_score(spark, data):
    got = models.eliminate_cv(data, list("abcd"), "two", folds=3, trees=5, depth=3).collect()
    scores = got[0]["scores"]
    assert len(scores) == 4 and got[0]["size"] == 4 - max(range(4), key=lambda i: (scores[i], i)) and got[0]["cv_score"] == max(scores)
    by = {r["feature"]: r for r in got}
    assert by["a"]["kept"] and sum(r["kept"] for r in got) == got[0]["size"]
    assert sorted(r["ranking"] for r in got) == [1] * got[0]["size"] + list(range(2, 6 - got[0]["size"]))
    none = models.eliminate_cv(data.limit(0), ["a", "b"], "two", folds=2, trees=2).collect()
    assert all(r["kept"] for r in none)


def test_support_vector_regression_near_a_plain_solver(spark, data):
    rows = data.toPandas()
    z, y = np.column_stack([np.ones(240), rows[list("abcd")].to_numpy()]), rows["y"].to_numpy()
    w, cost, slack = np.zeros(5), 1.0, 0.1
    for _ in range(20_000):  # plain descent
        e = z @ w - y
        w = w - 1e-3 * (np.array([0, *w[1:]]) + 2 * cost * z.T @ (np.sign(e) * np.maximum(np.abs(e) - slack, 0)))
    assert np.allclose(models.svr_weights(data, list("abcd"), "y", cost, slack), w, atol=1e-5)


def test_neighbours_predict_as_brute_force(spark, data):
    train, test = data.where("k % 3 > 0"), data.where("k % 3 = 0")
    a, b = (df.toPandas().sort_values("k") for df in (train, test))
    d = np.square(b[["a", "b"]].to_numpy()[:, None] - a[["a", "b"]].to_numpy()[None]).sum(2)
    near = np.argsort(d, axis=1)[:, :5]
    got = models.knn_predictions(train, test, ["a", "b"], "two", "classification").toPandas().sort_values("k")
    assert (got["prediction"].to_numpy() == (a["two"].to_numpy()[near].mean(1) > 0.5)).all()
    got = models.knn_predictions(train, test, ["a", "b"], "y", "regression").toPandas().sort_values("k")
    assert np.allclose(got["prediction"], a["y"].to_numpy()[near].mean(1))


def test_kernels_are_compared(spark, data):
    by = {r["model"]: r["mean_score"] for r in models.compare_kernels(data, ["a", "b"], "two").collect()}
    assert set(by) == {"svm", "neighbours"} and min(by.values()) > 0.8
    by = {r["model"]: r["mean_score"] for r in models.compare_kernels(data, ["a", "b"], "y").collect()}
    assert set(by) == {"svr", "neighbours"} and by["svr"] > 0.95 and by["neighbours"] > 0.8


def test_aggregates_merge_and_report_progress(spark, data):
    calls = []
    args = (lambda c: (len(c), c["y"].sum()), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: None if s is None else s[1] / s[0])
    got = loader.aggregate_in_chunks(data.repartition(70), *args, chunk_rows=7, progress=lambda *x: calls.append(x), every=0.05)
    assert got == pytest.approx(data.agg(F.avg("y")).first()[0]) and calls[-1] == (240, 240) and all(a <= b for a, b in calls)
    assert loader.aggregate_in_chunks(data.limit(0), *args) is None


def test_every_row_is_in_one_part_of_a_database_read(spark):
    rows = [(None, 0)] + [(v, 1) for v in range(-20, 50)]
    df = spark.createDataFrame(rows, "v long, w int").selectExpr("v", "cast(v / 7 as double) AS x", "date_add(DATE'2020-01-01', cast(v as int)) AS d", "timestamp_millis(v * 3600000) AS t")
    low, high = df.agg(*(F.struct(F.min(c), F.max(c)) for c in df.columns)).first(), None
    for c, (low_c, high_c) in zip(df.columns, low):
        for parts in (1, 2, 5):
            found = loader.range_predicates(c, low_c, high_c, parts)
            assert len(found) == parts
            hits = df.select(sum(F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in found).alias("n"))
            assert {r["n"] for r in hits.collect()} == {1}
    assert loader.range_predicates("v", 3, 3, 8) == loader.range_predicates("v", None, None, 8) == ["1 = 1"] and high is None
    hits = df.select(sum(F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in loader.hash_predicates("v", 4)).alias("n"))
    assert {r["n"] for r in hits.collect()} == {1}


def test_encodings_are_told_by_all_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.csv").write_bytes(b"x\n" + b"plain\n" * 400_000)
    (tmp_path / "a/2.csv").write_bytes("x\nfür\n".encode("iso-8859-1"))
    assert loader._encoding(spark, f"{tmp_path}/a") == "iso-8859-1" and loader._encoding(spark, f"{tmp_path}/a/1.csv") == "utf-8"
    assert loader.load(spark, f"{tmp_path}/a/2.csv").first()["x"] == "für"


@pytest.mark.parametrize(("n", "m"), [(1, 1), (3, 4), (5, 5), (2, 6)])
def test_exact_ks_equals_enumeration(n, m):
    found = []
    for chosen in combinations(range(n + m), n):
        i = j = top = 0
        for p in range(n + m):
            i, j = i + (p in chosen), j + (p not in chosen)
            top = max(top, abs(i * m - j * n))
        found.append(top)
    for d in set(found):
        assert dist.ks_exact_sf(d / (n * m), n, m) == pytest.approx(np.mean(np.array(found) >= d), abs=1e-12)
    assert dist.ks_p(0.0, n, m) == 1.0


def test_exact_ks_meets_the_limit_and_keeps_small_values():
    assert dist.ks_exact_sf(0.05, 2000, 2000) == pytest.approx(dist.ks_sf(0.05, 2000, 2000), rel=0.05)
    assert 0 < dist.ks_exact_sf(1.0, 60, 60) < 1e-33
    assert dist.ks_p(0.02, 20_000, 20_000) == dist.ks_sf(0.02, 20_000, 20_000)


def test_permuted_rows_are_scored_in_one_scan(spark, monkeypatch):
    """However many columns there are, a repeat reads its permuted rows once, and nothing of them is written again."""
    scans, written = [], []
    scored, write = models.scores_of, models.checkpointed
    monkeypatch.setattr(models, "scores_of", lambda *a: scans.append(1) or scored(*a))
    monkeypatch.setattr(models, "checkpointed", lambda df: written.append(1) or write(df))
    df = spark.range(300).selectExpr("cast(id as double) AS a", "cast(id * 7 % 31 as double) AS b", "cast(id * 5 % 13 as double) AS c", "2.0 * id AS y")

    class First:
        def predict(self, x):
            return 2 * x[:, 0]

    got = {r["feature"]: r["importance"] for r in models.model_importance(df, ["a", "b", "c"], "y", First(), 2).collect()}
    assert got["a"] > 0.5 and got["b"] == got["c"] == 0
    assert len(scans) == 1 + 2 and len(written) == 1
