"""Findings of round 3."""

import numpy as np
import pandas as pd

from assaykit.operators import leakage


def test_near_duplicates_miss_no_pair_and_name_the_least_key(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    near = lambda i, far: (base[i] + far * rng.normal(size=16)).tolist()
    train = [(k, near(k % 40, 0.2)) for k in range(400)] + [(900, [float("nan")] * 16), (901, [0.0] * 16), (902, None), (903, [1.0, 2.0])]
    test = [(k, near(k % 40, 0.2)) for k in range(120)] + [(990, [0.0] * 16), (991, None), (992, [2.0, 4.0])]
    a, b = (spark.createDataFrame(rows, "k long, v array<double>") for rows in (train, test))
    unit = lambda rows: {k: np.array(v) / np.linalg.norm(v) for k, v in rows if v and len(v) == 16 and np.linalg.norm(v) > 0}
    x, y = unit(train), unit(test)
    want = {}
    for k, v in y.items():
        found = {o: float(v @ w) for o, w in x.items() if v @ w >= 0.95}
        if found:
            best = min(found, key=lambda o: (-round(found[o], 9), o))
            want[k] = (best, min(found), round(found[best], 9))
    for block in (8_192, 50):
        got = leakage.near_duplicates(a, b, "v", "k", block=block).collect()
        assert {r["k"]: (r["other"], r["first"], round(r["cosine"], 9)) for r in got if r["k"] != 992} == want
        assert [(r["other"], round(r["cosine"], 9)) for r in got if r["k"] == 992] == [(903, 1.0)]
    assert any(best != first for best, first, _ in want.values())


def test_near_dup_cosine_matches_sql_with_near_copies(spark, tmp_path):
    import duckdb

    from assaykit.queries import ORACLE_SQL, QUERIES

    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 16))
    rows = [(k, (base[k % 31 % 30] + 0.1 * rng.normal(size=16)).astype("float32").tolist()) for k in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["near_dup_cosine"](spark, str(tmp_path)).toPandas().sort_values("k").reset_index(drop=True)
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = c.sql(ORACLE_SQL["near_dup_cosine"]).df().sort_values("k").reset_index(drop=True)
    assert len(want) > 100
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_cells_are_joined_by_boxes_as_by_all_pairs(spark):
    from pyspark.sql import functions as F

    from assaykit.operators import modelling

    rng = np.random.default_rng(7)
    eps, side = 0.5, 0.5 / np.sqrt(2)
    x = rng.uniform(0, 3, size=(6_000, 2))
    gone = (np.abs(x[:, 0] - 1.2) < 0.249) | (np.abs(x[:, 1] + x[:, 0] / 3 - 2.1) < 0.262)  # gaps close to eps, one of them aslant
    x = np.unique(np.concatenate([x[~gone], [[1.2, 0.3]]]), axis=0)
    cells = [tuple(int(v) for v in np.floor(p / side)) for p in x]
    points = spark.createDataFrame([(list(c), p.tolist()) for c, p in zip(cells, x)], "cell array<long>, x array<double>")
    by = {c: x[[i for i, other in enumerate(cells) if other == c]] for c in set(cells)}
    pairs = [(a, b) for a in by for b in by if a < b and max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 2]
    want = {(a, b) for a, b in pairs if (np.square(by[a][:, None] - by[b][None]).sum(-1) <= eps * eps).any()}
    given = spark.createDataFrame([(list(a), list(b)) for a, b in pairs], "a array<long>, b array<long>")
    for direct in (4, 4_096):
        got = {(tuple(r["a"]), tuple(r["b"])) for r in modelling._near_cells(points, given, 2, side, eps, direct).collect()}
        assert got == want
    assert 0 < len(want) < len(pairs)
    assert modelling._near_cells(points, given.where(F.lit(False)), 2, side, eps) is None


def test_dbscan_of_dense_cells_that_stay_apart_ends(spark):
    """80,000 rows in two neighbouring cells with a gap between: 1.6 billion pairs if rows meet rows."""
    import time

    from assaykit.operators import modelling

    n = 40_000
    left = np.linspace(0.0, 0.2, n)
    a = np.concatenate([left, left + 0.72])
    pad = np.array([-30.0, 30.0])
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(2 * n + 2), "a": np.concatenate([a, pad])}))
    spread = np.concatenate([a, pad]).std()
    began = time.time()
    got = modelling.dbscan(df, "k", ["a"], 0.5 / spread).toPandas().set_index("row_key").sort_index()
    assert got.loc[: n - 1, "cluster"].nunique() == 1 and got.loc[n : 2 * n - 1, "cluster"].nunique() == 1
    assert got.loc[0, "cluster"] != got.loc[n, "cluster"] and got["is_noise"].sum() == 2
    assert time.time() - began < 60


def test_boruta_permutes_once_a_round_and_keeps_its_permutation(spark, monkeypatch):
    from pyspark.sql import functions as F

    from assaykit.operators import modelling

    rng = np.random.default_rng(8)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.normal(size=300).round(1), "b": rng.normal(size=300).round(1), "y": rng.integers(0, 2, 300)}))
    got = modelling.permuted(df, ["a", "b"], 3).toPandas()
    key = lambda salt: F.xxhash64(F.lit(salt), "a", "b", "y")
    left = df.orderBy(key(3), "a", "b", "y").toPandas()
    right = df.orderBy(key(4), "a", "b", "y").toPandas()
    want = left.assign(__p_a=right["a"], __p_b=right["b"])
    order = list(want.columns)
    pd.testing.assert_frame_equal(got[order].sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True))
    fills = []
    monkeypatch.setattr(modelling, "filled", lambda rows, cols, real=modelling.filled: fills.append(len(cols)) or real(rows, cols))
    modelling.boruta(df, ["a", "b"], "y", rounds=2, trees=3)
    assert fills == [2]  # gaps are filled once, not in each round's permuted rows again


def test_information_of_all_columns_takes_one_histogram(spark, monkeypatch):
    """Each column's information is that of the column alone, and the table is read for quantiles once."""
    from assaykit.operators import leakage_report

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.normal(size=900), "b": rng.integers(0, 5, 900) * 1.0, "flat": 1.0, "none": np.nan})
    pdf["t"] = np.where(pdf["a"] + rng.normal(size=900) > 0, "x", "y")
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    alone = {c: leakage.binned_information(df, c, "t").first()["mi"] for c in ("a", "b", "flat", "none")}
    calls, whole = [], leakage.exact_quantiles
    monkeypatch.setattr(leakage, "exact_quantiles", lambda df, cols, points: calls.append(list(cols)) or whole(df, cols, points))
    got = {r["feature"]: r["normalised"] for r in leakage_report.information(df, ["a", "b", "flat", "none"], "t").collect()}
    assert calls == [["a", "b", "flat", "none"]]
    shares = (pdf["t"].value_counts() / 900).to_numpy()
    bits = -(shares * np.log2(shares)).sum()
    assert alone["a"] > 0.1 and alone["none"] is None and abs(alone["flat"]) < 1e-12
    assert all(abs(got[c] - (alone[c] or 0.0) / bits) < 1e-9 for c in alone)
