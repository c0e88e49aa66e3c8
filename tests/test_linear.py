"""Sparse paths and chained equations against plain solvers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaykit.operators import linear

COLS = list("abcde")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = pd.DataFrame(rng.normal(size=(400, 5)), columns=COLS)
    x["b"] += 0.7 * x["a"]
    x["e"] = 4.0
    y = 3 * x.a - 2 * x.c + rng.normal(size=400)
    two = (x.a - x.c + rng.normal(size=400) > 0.2).map({True: "yes", False: "no"})
    return spark.createDataFrame(x.assign(k=range(400), y=y, two=two)).cache()


def folds_of(data, target, seed=42):
    """Rows as the operator standardises and deals them."""
    rows, names = linear._standard(data, COLS, target, 5, seed)
    got = rows.toPandas()
    return got[names].to_numpy(), got["y"].to_numpy(), got["fold"].to_numpy()


def plain_net(z, y, strength, ratio, steps=3000):
    """Proximal gradient, with an intercept."""
    mz, my = z.mean(0), y.mean()
    g, m = (z - mz).T @ (z - mz) / len(z), (z - mz).T @ (y - my) / len(z)
    w, rate = np.zeros(z.shape[1]), 1 / (np.linalg.norm(g, 2) + strength)
    for _ in range(steps):
        v = w - rate * (g @ w - m + strength * (1 - ratio) * w)
        w = np.sign(v) * np.maximum(np.abs(v) - rate * strength * ratio, 0)
    return w, my - mz @ w


@pytest.mark.parametrize("ratios", [(1.0,), (0.1, 0.9)])
def test_path_and_choice_equal_a_plain_solver(spark, data, ratios):
    z, y, fold = folds_of(data, "y")
    got = linear.sparse_path(data, COLS, "y", ratios, strengths=12).collect()
    best = None
    for r in ratios:
        top = np.abs((z - z.mean(0)).T @ (y - y.mean())).max() / len(z) / r
        for s in top * np.logspace(0, -3, 12):
            errors = []
            for f in range(5):
                w, b = plain_net(z[fold != f], y[fold != f], s, r)
                errors.append(np.square(y[fold == f] - z[fold == f] @ w - b).mean())
            if best is None or np.mean(errors) < best[0] - 1e-9:
                best = (np.mean(errors), s, r)
    w, _ = plain_net(z, y, best[1], best[2])
    assert got[0]["strength"] == pytest.approx(best[1]) and got[0]["ratio"] == best[2] and got[0]["cv_error"] == pytest.approx(best[0], rel=1e-5)
    assert np.allclose([r["coefficient"] for r in got], w, atol=1e-5)
    by = {r["feature"]: r for r in got}
    assert by["a"]["kept"] and by["c"]["kept"] and not by["e"]["kept"] and max(r["score"] for r in got) == 1.0


def plain_logistic(z, y, cost, steps=6000):
    w, b, n = np.zeros(z.shape[1]), 0.0, len(z)
    rate = 4 / (np.linalg.norm(np.column_stack([np.ones(n), z]), 2) ** 2 / n)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        v, b = w + rate * z.T @ (y - p) / n, b + rate * (y - p).mean()
        w = np.sign(v) * np.maximum(np.abs(v) - rate / (cost * n), 0)
    return w, b


def test_logistic_path_equals_a_plain_solver(spark, data):
    costs = (0.001, 0.02, 0.5)
    z, y, fold = folds_of(data.withColumn("two", (F.col("two") == "yes").cast("double")), "two")
    errors = []
    for c in costs:
        e = []
        for f in range(5):
            w, b = plain_logistic(z[fold != f], y[fold != f], c)
            e.append(((z[fold == f] @ w + b > 0) != y[fold == f]).mean())
        errors.append(np.mean(e))
    got = linear.logistic_path(data, COLS, "two", costs=costs).collect()
    w, _ = plain_logistic(z, y, costs[int(np.argmin(errors))])
    assert got[0]["cv_error"] == pytest.approx(min(errors), abs=1e-9) and got[0]["strength"] == pytest.approx(1 / (costs[int(np.argmin(errors))] * 400))
    assert np.allclose([r["coefficient"] for r in got], w, atol=2e-4)


def test_linear_edges(spark, data):
    none = linear.sparse_path(data.limit(0), COLS, "y").collect()
    assert len(none) == 5 and not any(r["kept"] for r in none) and none[0]["cv_error"] is None
    assert not any(r["kept"] for r in linear.logistic_path(data.limit(0), COLS, "two").collect())
    gaps = data.withColumn("a", F.when(F.col("k") % 3 == 0, None).otherwise(F.col("a"))).withColumn("y", F.when(F.col("k") % 7 > 0, F.col("y")))
    assert {r["feature"] for r in linear.lasso(gaps, COLS, "y").where("kept").collect()} >= {"a", "c"}
    split = data.withColumn("two", (F.col("a") > 0).cast("int"))  # separable
    assert linear.elastic_net(split, ["a", "b"], "two").where("feature = 'a'").first()["kept"]
    with pytest.raises(ValueError, match="two classes"):
        linear.logistic_path(data.withColumn("three", F.col("k") % 3), COLS, "three")


def test_sweep_solves_and_passes_over_what_is_explained():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(50), rng.normal(size=(50, 2))])
    x = np.column_stack([x, x[:, 1] + x[:, 2]])
    y = x @ [1.0, 2.0, -1.0, 0.0] + 0.1 * rng.normal(size=50)
    v = np.column_stack([x, y])
    w = linear.swept(v.T @ v, range(4))[:-1]
    assert w[3] == 0 and np.allclose(w[:3], np.linalg.lstsq(x[:, :3], y, rcond=None)[0])


def plain_chain(x, rounds):
    x = x.copy()
    gap = np.isnan(x)
    x = np.where(gap, np.nanmean(x, 0), x)
    order = sorted((j for j in range(x.shape[1]) if gap[:, j].any()), key=lambda j: (gap[:, j].sum(), j))
    for _ in range(rounds):
        for j in order:
            others = np.column_stack([np.ones(len(x)), np.delete(x, j, 1)])
            w = np.linalg.lstsq(others[~gap[:, j]], x[~gap[:, j], j], rcond=None)[0]
            x[gap[:, j], j] = others[gap[:, j]] @ w
    return x


@pytest.mark.parametrize("rounds", [1, 10])
def test_chained_equations_equal_a_plain_version(spark, data, rounds):
    x = data.select("k", "a", "b", "c", "y").toPandas().sort_values("k").to_numpy(float)[:, 1:]
    x[np.random.default_rng(3).random(x.shape) < 0.15] = np.nan
    df = spark.createDataFrame([(i, f"t{i}", *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "k long, note string, a double, b double, c double, y double")
    out = linear.iterative_impute(df, ["a", "b", "c", "y"], rounds)
    assert out.columns == df.columns and "LinearRegression" not in out._jdf.queryExecution().toString()
    got = out.toPandas().sort_values("k")
    assert (got["note"] == [f"t{i}" for i in range(400)]).all()
    assert np.allclose(got[["a", "b", "c", "y"]].to_numpy(), plain_chain(x, rounds), rtol=1e-6, atol=1e-8)


def test_chained_equations_edges(spark):
    df = spark.createDataFrame([(1, 2, None, None), (2, None, None, 5.0), (3, 4, None, 7.0)], "k int, a int, b double, c double")
    got = {r["k"]: r for r in linear.iterative_impute(df, ["a", "b", "c"]).collect()}
    assert all(r["b"] is None for r in got.values()) and got[1]["c"] is not None and got[2]["a"] is not None and got[3]["a"] == 4.0
    assert linear.iterative_impute(df.limit(0), ["a", "b", "c"]).count() == 0


def test_components_match_a_decomposition(spark, data):
    df = data.withColumn("a", F.when(F.col("k") % 9 > 0, F.col("a"))).withColumn("b", F.when(F.col("k") == 3, 90.0).when(F.col("k") == 4, float("inf")).otherwise(F.col("b")))
    got = linear.principal(df, COLS)
    x = df.select("k", *COLS).toPandas().sort_values("k")[COLS].replace(np.inf, np.nan)
    x = x.fillna(x.median())
    x = x.clip(x.mean() - 5 * x.std(ddof=0), x.mean() + 5 * x.std(ddof=0), axis=1)
    z = ((x - x.mean()) / x.std(ddof=0).replace(0, 1)).to_numpy()
    _, s, v = np.linalg.svd(z, full_matrices=False)
    rows = got["components"].collect()
    assert np.allclose([r["singular_value"] for r in rows], s, atol=1e-5) and np.allclose([r["explained"] for r in rows], s**2 / (s**2).sum(), atol=1e-9)
    first = [r for r in got["loadings"].collect() if r["component"] == 1]
    assert np.allclose([abs(r["loading"]) for r in first], np.sort(np.abs(v[0]))[::-1], atol=1e-8) and first[0]["loading"] > 0
    placed = got["place"](df, "k", 3).toPandas().sort_values("row_key")[["pc_1", "pc_2", "pc_3"]].to_numpy()
    assert np.allclose(np.abs(placed), np.abs(z @ v[:3].T), atol=1e-8)
    assert got["needed"][80] == int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.8) + 1)
    assert linear.principal(df.limit(0), COLS)["components"].count() == 5
