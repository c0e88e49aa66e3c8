"""The neighbour join and the operators on it against brute force."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import neighbours
from assaykit.operators.normality import _digamma, ksg_information
from assaykit.plans import neighbours as plan

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def small(monkeypatch):
    """Many cells, blocks and leaves on little data."""
    monkeypatch.setattr(plan, "CELL_POINTS", 40)
    monkeypatch.setattr(plan, "QUERY_BLOCK", 25)
    monkeypatch.setattr(plan, "LEAF", 7)


def plain(x, y, k, metric):
    gap = np.abs(y[:, None] - x[None])
    d = gap.max(2) if metric == "max" else plan.norm(y[:, None] - x[None], metric)
    return [sorted((float(v), i) for i, v in enumerate(r))[:k] for r in d]


@pytest.mark.parametrize("metric", ["euclidean", "max"])
@pytest.mark.parametrize("kind", ["spread", "clumps", "grid", "line"])
def test_join_equals_brute_force(spark, small, metric, kind):
    rng = np.random.default_rng(1)
    x = {"spread": rng.normal(size=(400, 3)), "clumps": np.concatenate([rng.normal(c, 0.01, (80, 2)) for c in range(5)]), "grid": rng.integers(0, 6, (300, 2)) * 1.0, "line": np.arange(200.0)[:, None] ** 2}[kind]
    y = np.concatenate([x[::3], x[:5] + 100.0, x[:1] - 50])  # also far from all points
    points = spark.createDataFrame([(i, r.tolist(), 2) for i, r in enumerate(x)], "id long, x array<double>, weight long")
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y)], "qid long, x array<double>")
    got = {r["qid"]: [(e["dist"], e["id"]) for e in r["near"]] for r in plan.knn_join(queries, points, 6, metric).collect()}
    want = plain(x, y, 6, metric)
    assert [got[i] for i in range(len(y))] == want


def test_join_of_few_or_no_points(spark):
    queries = spark.createDataFrame([(1, [0.0]), (2, [5.0])], "qid long, x array<double>")
    points = spark.createDataFrame([(7, [4.0], 1)], "id long, x array<double>, weight long")
    assert {r["qid"]: [e["id"] for e in r["near"]] for r in plan.knn_join(queries, points, 3).collect()} == {1: [7], 2: [7]}
    assert [list(r["near"]) for r in plan.knn_join(queries, points.limit(0), 3).collect()] == [[], []]
    assert plan.knn_join(queries.limit(0), points, 3).count() == 0


def test_counts_upto(spark):
    rng = np.random.default_rng(2)
    v, asked = rng.integers(0, 30, 200) * 1.0, rng.integers(-3, 33, 100) * 1.0
    data = spark.createDataFrame([(x,) for x in v.tolist()], "v double").groupBy("v").agg(F.count("*").alias("weight"))
    got = plan.counts_upto(data, spark.createDataFrame([(i, 0, a) for i, a in enumerate(asked.tolist())], "qid long, which int, v double"))
    assert {r["qid"]: r["n"] for r in got.collect()} == {i: int((v <= a).sum()) for i, a in enumerate(asked)}


def plain_lof(z, k):
    """Equal rows are one place; a place's rows are neighbours of each other first."""
    places, first, of, weight = np.unique(z, axis=0, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first)  # places by their smallest key
    rank = np.argsort(order)
    places, weight, of = places[order], weight[order], rank[of.ravel()]
    near = []
    for i, p in enumerate(places):
        d = plan.norm(places - p, "euclidean")
        left, got = k, []
        for v, j in sorted((float(v), j) for j, v in enumerate(d)):
            t = min(left, weight[j] - (j == i))
            if t > 0:
                got.append((j, v, t))
                left -= t
        near.append(got)
    kdist = [g[-1][1] for g in near]
    density = [1 / (sum(t * max(v, kdist[j]) for j, v, t in g) / k + 1e-10) for g in near]
    score = [sum(t * density[j] for j, _, t in g) / k / density[i] for i, g in enumerate(near)]
    return np.array(score)[of]


def test_lof_equals_brute_force_over_all_rows(spark, small):
    e = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("event_id", "value", "cast(user_id as double) AS user_id")
    e = e.union(e.where("event_id % 3 = 0").selectExpr("event_id + 100000", "7.0", "3.0"))  # a third of the rows are equal
    x = neighbours._standard(e, ["value", "user_id"]).toPandas().sort_values("event_id")[["value", "user_id"]].to_numpy(float)
    got = neighbours.local_outliers(e, "event_id", ["value", "user_id"]).toPandas().sort_values("row_key")
    want = plain_lof(x, 20)
    assert len(got) == len(x) and np.allclose(got["score"], want, rtol=1e-9)
    assert 0.03 < got["is_outlier"].mean() < 0.051


def test_lof_edges(spark):
    df = spark.createDataFrame([(i, 1.0, None) for i in range(8)], "k int, a double, b double")
    assert {r["score"] for r in neighbours.local_outliers(df, "k", ["a", "b"]).collect()} == {1.0}
    assert neighbours.local_outliers(df.limit(0), "k", ["a", "b"]).count() == 0
    assert neighbours.local_outliers(df.limit(1), "k", ["a", "b"]).count() == 1


def plain_fill(x, k):
    n, out = x.shape[1], x.copy()
    for i, j in np.argwhere(np.isnan(x)):
        donors = []
        for r in np.flatnonzero(~np.isnan(x[:, j])):
            both = np.flatnonzero(~np.isnan(x[i]) & ~np.isnan(x[r]))
            if len(both):
                donors.append((float(plan.norm(x[i, both] - x[r, both], "euclidean")) * (n / len(both)) ** 0.5, r))
        near = sorted(donors)[:k]
        out[i, j] = np.mean([x[r, j] for _, r in near]) if near else np.nanmean(x[:, j])
    return out


def test_fill_equals_brute_force_with_every_pattern_of_gaps(spark, small):
    rng = np.random.default_rng(3)
    x = np.stack([rng.normal(size=240), rng.integers(0, 4, 240) * 1.0, rng.normal(size=240)], 1)
    x[rng.random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "k long, a double, b double, c double")
    got = neighbours.knn_impute(df, "k", ["a", "b", "c"]).toPandas().sort_values("k")[["a", "b", "c"]].to_numpy()
    assert np.isnan(x).all(1).any() and np.allclose(got, plain_fill(x, 5), rtol=1e-12)


def test_fill_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3.0, None), (3, 5.0, None)], "k long, a double, b double")
    got = {r["k"]: (r["a"], r["b"]) for r in neighbours.knn_impute(df, "k", ["a", "b"]).collect()}
    assert got == {1: (4.0, None), 2: (3.0, None), 3: (5.0, None)}
    assert neighbours.knn_impute(df.limit(0), "k", ["a", "b"]).count() == 0


def test_information_equals_the_definition_over_all_rows(spark, small):
    o = spark.read.parquet(f"{DATA}/orders.parquet").selectExpr("o_orderkey", "o_totalprice AS price", "cast(month(o_orderdate) AS double) AS month", "o_totalprice * 2 + o_custkey AS near").limit(1000)
    o = o.union(spark.createDataFrame([(10**7 + i, 1.0, 2.0, None) for i in range(10)], o.schema))  # equal rows, a gap
    got = {r["feature"]: r for r in neighbours.neighbour_information(o, ["month", "near"], "price").collect()}
    for c in ("month", "near"):
        both = o.select(c, "price").toPandas().dropna()
        z = ((both - both.mean()) / both.std()).to_numpy()
        assert got[c]["n"] == len(z) and got[c]["mi"] == pytest.approx(ksg_information(z[:, 0], z[:, 1]) if c == "near" else plain_information(z), abs=1e-6)
    assert got["near"]["mi"] > 3 > got["near"]["normalised"] == 1.0
    assert neighbours.neighbour_information(o.limit(5), ["month"], "price").first()["mi"] == 0.0


def plain_information(z, k=3):
    """As the definition, a row being one of its own neighbours in a column even where the distance is 0."""
    a, b = (np.abs(z[:, None, i] - z[None, :, i]) for i in (0, 1))
    both = np.maximum(a, b)
    np.fill_diagonal(both, np.inf)
    reach = np.partition(both, k - 1, axis=1)[:, k - 1 : k]
    n = [np.maximum((s < reach - 1e-10).sum(1), 1) for s in (a, b)]
    return max(0.0, float(_digamma(np.array([k]))[0] + _digamma(np.array([len(z)]))[0] - (_digamma(n[0] * 1.0) + _digamma(n[1] * 1.0)).mean()))


def test_digamma(spark):
    got = spark.range(1, 40).select(neighbours.digamma(F.col("id")).alias("d")).toPandas()["d"]
    assert np.allclose(got, _digamma(np.arange(1, 40)), atol=1e-9)


def test_leaves_hold_every_row_once():
    assert plan._leaves(np.zeros((0, 2))) == [] and sorted(np.concatenate(plan._leaves(np.zeros((500, 2)))).tolist()) == list(range(500))


def test_search_of_a_cell_is_exact_and_keeps_to_the_ball():
    """Ties and limits as by brute force; points of a leaf that lie outside the run's ball are not compared."""
    rng = np.random.default_rng(3)
    for metric in ("max", "euclidean"):
        x, y = rng.integers(0, 7, (600, 3)) * 1.0, rng.integers(0, 7, (300, 3)) * 1.0
        ids, far = rng.permutation(600), np.where(rng.random(300) < 0.5, np.inf, 2.0)
        at, dist = plan.nearest(x, ids, y, 5, far, metric)
        gap = np.abs(y[:, None] - x[None])
        d = gap.max(-1) if metric == "max" else np.sqrt(gap[..., 0] ** 2 + gap[..., 1] ** 2 + gap[..., 2] ** 2)
        for i in range(300):
            want = sorted((v, ids[j], j) for j, v in enumerate(d[i]) if v <= far[i])[:5]
            assert [(v, j) for v, _, j in want] == [(v, j) for v, j in zip(dist[i], at[i]) if j >= 0]
    x = rng.normal(size=(6000, 4))
    tracemalloc.start()
    plan.nearest(x, np.arange(6000), x, 6, np.full(6000, np.inf), "euclidean")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # 31 MB before, 12 MB now


@pytest.mark.parametrize("kind", ["spread", "grid", "clumps"])
def test_lof_writes_lists_of_the_cells_edges_only(spark, monkeypatch, kind):
    """Scores equal brute force whether a place's neighbours are in its cell or not; only where they are not, lists of neighbours are written."""
    monkeypatch.setattr(plan, "CELL_POINTS", 500)
    rng = np.random.default_rng(5)
    z = {"spread": rng.normal(size=(2000, 2)), "grid": rng.integers(0, 40, (2000, 2)) * 1.0, "clumps": np.concatenate([rng.normal(c * 50, 1, (500, 2)) for c in range(4)])}[kind]
    lists, entries = [], []
    made = neighbours.own_neighbours

    def watched(places, k):
        state, near = made(places, k)
        lists.append(near.count())
        entries.append(state.count())
        return state, near

    monkeypatch.setattr(neighbours, "own_neighbours", watched)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(z)], "k int, a double, b double")
    got = neighbours.local_outliers(df, "k", ["a", "b"]).toPandas().sort_values("row_key")
    x = neighbours._standard(df, ["a", "b"]).toPandas().sort_values("k")[["a", "b"]].to_numpy(float)
    assert np.allclose(got["score"], plain_lof(x, 20), rtol=1e-9)
    assert entries == [len(np.unique(z, axis=0))] and lists[0] < 0.75 * entries[0]
