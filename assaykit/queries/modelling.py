"""Queries of model-backed operators; where SQL can't express them, tests hold them to properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import modelling as m
from ..operators import ensemble, leakage_report, linear, models, neighbours, normality, prepare, scoring, shap
from ..session import read_table
from ..sources import loader
from .analysis import r6

QUERIES: dict = {}
SQL: dict[str, str] = {}
COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _orders(spark, d):
    """Orders with a target that depends on the first two features."""
    o = read_table(spark, d, "orders")
    return o.selectExpr("o_orderkey", "o_totalprice AS price", "cast(month(o_orderdate) as double) AS month", "cast(o_custkey % 97 as double) AS noise", "cast(o_orderkey % 89 as double) AS noise2", "cast(o_totalprice + 20000 * month(o_orderdate) > 330000 as int) AS y")


def _events(spark, d):
    return read_table(spark, d, "events").selectExpr("event_id", "value", "cast(user_id as double) AS user_id")


FEATS = ["price", "month", "noise", "noise2"]


@query
def rf_importance(spark, d):
    return r6(m.forest_importance(_orders(spark, d), FEATS, "y", 20, 5))


@query
def permutation_importance(spark, d):
    return r6(m.permutation_importance(_orders(spark, d), FEATS, "y", repeats=2, trees=10))


@query
def fs_lasso(spark, d):
    return r6(m.sparse_selection(_orders(spark, d), FEATS, "y"))


@query
def fs_elastic_net(spark, d):
    return r6(m.sparse_selection(_orders(spark, d), FEATS, "y", 0.5))


@query
def fs_lasso_cv(spark, d):
    """Two classes; the strength is chosen over five folds and ten strengths."""
    return r6(linear.lasso(_orders(spark, d), FEATS, "y").drop("coefficient", "cv_error"), 3, score=2)


@query
def fs_elastic_net_cv(spark, d):
    """A numeric target; strength and ratio are chosen over five folds, a hundred strengths and four ratios."""
    o = _orders(spark, d).selectExpr("*", "(price + 15000 * month + 100 * noise) / 150000 AS cost")
    return r6(linear.elastic_net(o, ["month", "noise", "noise2", "price"], "cost"), 3)


@query
def fs_rfe(spark, d):
    return m.recursive_elimination(_orders(spark, d), FEATS, "y", 2, trees=10)


@query
def fs_boruta(spark, d):
    return m.boruta(_orders(spark, d), FEATS, "y", rounds=3, trees=10)


@query
def fs_mrmr(spark, d):
    return r6(m.mrmr(_orders(spark, d), FEATS, "y", 3))


@query
def dim_pca(spark, d):
    return r6(m.pca(read_table(spark, d, "lineitem").selectExpr(*COLS, "l_extendedprice * (1 - l_discount) AS net"), [*COLS, "net"]), 4)


@query
def dim_tsne(spark, d):
    e = read_table(spark, d, "embeddings").where("embedding is not null")
    return m.tsne(e.select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8))), "vec_id", [f"e{i}" for i in range(8)], limit=200, steps=100)


@query
def iforest(spark, d):
    return m.isolation_forest(read_table(spark, d, "events").selectExpr("event_id", "value", "cast(user_id as double) AS user_id"), "event_id", ["value", "user_id"], trees=50)


@query
def lof(spark, d):
    return r6(neighbours.local_outliers(_events(spark, d), "event_id", ["value", "user_id"]))


@query
def dbscan(spark, d):
    return m.dbscan(read_table(spark, d, "events").selectExpr("event_id", "value", "cast(user_id as double) AS user_id"), "event_id", ["value", "user_id"])


@query
def knn_impute(spark, d):
    df = read_table(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 20 = 0 THEN NULL ELSE value END AS value", "cast(user_id as double) AS user_id")
    return r6(neighbours.knn_impute(df, "event_id", ["value", "user_id"]))


SQL["knn_impute"] = """
WITH t AS (SELECT event_id, CASE WHEN event_id % 20 = 0 THEN NULL ELSE value END AS value, user_id::DOUBLE AS user_id FROM events),
near AS (SELECT a.event_id, b.value, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.user_id - b.user_id), b.event_id) AS place FROM t a, t b WHERE a.value IS NULL AND b.value IS NOT NULL),
fill AS (SELECT event_id, avg(value) AS fill FROM near WHERE place <= 5 GROUP BY event_id)
SELECT event_id, round(coalesce(value, fill), 6) + 0.0 AS value, user_id FROM t LEFT JOIN fill USING (event_id)"""


@query
def iterative_impute(spark, d):
    df = read_table(spark, d, "lineitem").selectExpr("l_quantity", "CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_extendedprice END AS price", "l_extendedprice * (1 - l_discount) AS net")
    return r6(linear.iterative_impute(df, ["l_quantity", "price", "net"]), 4, price=2)


SQL["iterative_impute"] = """
WITH t AS (SELECT l_quantity, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_extendedprice END AS price, l_extendedprice * (1 - l_discount) AS net FROM lineitem),
c AS (SELECT avg(price) AS mp, avg(l_quantity) AS mq, avg(net) AS mn, var_pop(l_quantity) AS qq, var_pop(net) AS nn, covar_pop(l_quantity, net) AS qn, covar_pop(l_quantity, price) AS qp, covar_pop(net, price) AS np FROM t WHERE price IS NOT NULL),
w AS (SELECT *, (qp * nn - np * qn) / (qq * nn - qn * qn) AS wq, (np * qq - qp * qn) / (qq * nn - qn * qn) AS wn FROM c)
SELECT round(l_quantity::DOUBLE, 4) AS l_quantity, round(coalesce(price, mp + wq * (l_quantity - mq) + wn * (net - mn)), 2) AS price, round(net, 4) AS net FROM t, w"""


@query
def quickml_compare(spark, d):
    return m.compare_models(_orders(spark, d), FEATS, "y", 2)


@query
def exp_influential(spark, d):
    return r6(m.influential(_orders(spark, d), "o_orderkey", FEATS, "y"))


def _explained(spark, d):
    return shap.explained(_orders(spark, d), "o_orderkey", FEATS, "y", trees=20, depth=5)


@query
def shap_summary(spark, d):
    return r6(shap.effects(_explained(spark, d)[0], FEATS))


@query
def shap_tree(spark, d):
    """Every row's attributions; they add up to its prediction."""
    values, _ = _explained(spark, d)
    return r6(values.select("row_key", "base", "prediction", *(F.col("shap")[i].alias(c) for i, c in enumerate(FEATS))))


@query
def shap_local(spark, d):
    return r6(shap.local(_explained(spark, d)[0], FEATS, 3))


@query
def shap_most_explained(spark, d):
    return r6(shap.most_explained(_explained(spark, d)[0], FEATS))


@query
def shap_interactions(spark, d):
    o = _orders(spark, d)
    _, paths = shap.explained(o, "o_orderkey", FEATS, "y", trees=20, depth=5)
    return r6(shap.strongest(shap.interaction_strengths(o, "o_orderkey", FEATS, paths)))


@query
def prep_pipeline(spark, d):
    o = read_table(spark, d, "orders")
    model = m.prepare(o, ["o_totalprice"], ["o_orderpriority", "o_orderstatus"])
    return model.transform(o).select("o_orderkey", F.size(m.vector_to_array("features")).alias("n_features"))


@query
def normality_k2(spark, d):
    return r6(normality.dagostino(read_table(spark, d, "events"), ["value"]), 4)


SQL["normality_k2"] = """
WITH m AS (SELECT count(value)::DOUBLE AS n, avg(value) AS mu FROM events), s AS (SELECT any_value(n) AS n, avg(pow(value - mu, 2)) AS m2, avg(pow(value - mu, 3)) AS m3, avg(pow(value - mu, 4)) AS m4 FROM events, m WHERE value IS NOT NULL),
g AS (SELECT *, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) AS b2,
 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rb FROM s),
h AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS a,
 (b2 - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5))) AS x FROM g),
z AS (SELECT n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) AS z1, (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * cbrt((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM h)
SELECT 'value' AS feature, n::BIGINT AS n, round(z1 * z1 + z2 * z2, 4) AS k2, round(exp(-(z1 * z1 + z2 * z2) / 2), 4) AS p_value FROM z"""


@query
def normality_anderson(spark, d):
    return r6(normality.anderson_darling(read_table(spark, d, "events"), "value"), 4)


@query
def normality_shapiro(spark, d):
    r = normality.shapiro(read_table(spark, d, "events"), "value", "event_id")
    return spark.createDataFrame([(r["feature"], r["n"], r["w"], r["p_value"])], "feature string, n long, w double, p_value double")


@query
def leak_mi_neighbours(spark, d):
    return r6(neighbours.neighbour_information(_orders(spark, d), ["month", "noise"], "price"))


@query
def missing_predictability(spark, d):
    df = read_table(spark, d, "lineitem").selectExpr("l_quantity", "l_tax", "CASE WHEN l_quantity > 40 AND l_orderkey % 3 = 0 THEN NULL ELSE l_extendedprice END AS price")
    got = scoring.gap_predictability(df, "price", ["l_quantity", "l_tax"])
    return spark.createDataFrame([("price", float(got["accuracy"]), float(got["balanced_accuracy"]))], "feature string, accuracy double, balanced_accuracy double")


@query
def fs_rfe_cv(spark, d):
    """The number of columns is chosen over five folds."""
    return r6(models.eliminate_cv(_orders(spark, d), FEATS, "y", trees=10).drop("scores"), 3)


@query
def quickml_kernels(spark, d):
    return r6(models.compare_kernels(_orders(spark, d), FEATS, "y"))


class LinearToy:
    """A user's model: any object with predict or predict_proba over a matrix."""

    def predict(self, x):
        return 0.5 * x[:, 0] - 3.0 * x[:, 1] + 1.0

    def predict_proba(self, x):
        p = 1 / (1 + 2.0 ** (-self.predict(x) / 10))
        return [[1 - v, v] for v in p]


@query
def user_model_predictions(spark, d):
    df = read_table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_discount END AS discount")
    out = models.with_predictions(df, ["l_quantity", "discount"], LinearToy())
    return r6(models.with_predictions(out, ["l_quantity", "discount"], LinearToy(), "probabilities", 2).select("l_orderkey", "l_linenumber", "prediction", F.col("probabilities")[1].alias("probability")))


SQL["user_model_predictions"] = """
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_discount END AS discount FROM lineitem),
m AS (SELECT quantile_cont(discount, 0.5) AS mid FROM t),
p AS (SELECT l_orderkey, l_linenumber, 0.5 * l_quantity - 3.0 * coalesce(discount, mid) + 1.0 AS p FROM t, m)
SELECT l_orderkey, l_linenumber, round(p, 6) + 0.0 AS prediction, round(1 / (1 + pow(2.0, -p / 10)), 6) + 0.0 AS probability FROM p"""


@query
def user_model_importance(spark, d):
    df = read_table(spark, d, "lineitem").selectExpr("l_quantity", "l_discount", "0.5 * l_quantity - 3.0 * l_discount AS y")
    return r6(models.model_importance(df, ["l_quantity", "l_discount"], "y", LinearToy(), 2))


@query
def chunk_aggregate(spark, d):
    """A user's aggregate that merges states of chunks: rows, sum and largest value by return flag."""

    def partial(rows):
        return {f: (len(g), float(g.sum()), float(g.max())) for f, g in rows.groupby("l_returnflag")["l_extendedprice"]}

    def merge(a, b):
        both = lambda f: [x[f] for x in (a, b) if f in x]
        return {f: (sum(x[0] for x in both(f)), sum(x[1] for x in both(f)), max(x[2] for x in both(f))) for f in {*a, *b}}

    got = loader.aggregate_in_chunks(read_table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), partial, merge, chunk_rows=20_000)
    return r6(spark.createDataFrame([(f, *v) for f, v in sorted((got or {}).items())], "flag string, n long, total double, largest double"), 2)


SQL["chunk_aggregate"] = "SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(max(l_extendedprice), 2) AS largest FROM lineitem GROUP BY l_returnflag"


@query
def prep_setup(spark, d):
    """Types found, gaps filled, categories as indicators, numbers standardised, times in parts."""
    o = read_table(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status", "cast(o_orderdate as string) AS placed")
    p = prepare.setup(o, ignore=["o_orderkey"], normalize="zscore")
    return r6(p.transform(o, ["o_orderkey"]).select("o_orderkey", "num_price", *(f"cat_status_{v}" for v in p.categories["status"]), "placed_year", "placed_month_sin", "placed_dow_cos", "placed_is_weekend"))


SQL["prep_setup"] = """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status, o_orderdate AS placed FROM orders),
top AS (SELECT status AS mode FROM t WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1),
m AS (SELECT avg(price) AS mean FROM t), f AS (SELECT t.*, coalesce(price, mean) AS p, coalesce(status, mode) AS s FROM t, m, top), z AS (SELECT avg(p) AS zm, stddev_pop(p) AS zs FROM f)
SELECT o_orderkey, round((p - zm) / zs, 6) + 0.0 AS num_price, (s = 'F')::DOUBLE AS "cat_status_F", (s = 'O')::DOUBLE AS "cat_status_O", (s = 'P')::DOUBLE AS "cat_status_P",
 year(placed)::DOUBLE AS placed_year, round(sin(2 * pi() * month(placed) / 12), 6) + 0.0 AS placed_month_sin, round(cos(2 * pi() * (isodow(placed) - 1) / 7), 6) + 0.0 AS placed_dow_cos, (isodow(placed) >= 6)::INT::DOUBLE AS placed_is_weekend FROM f, z"""


@query
def prep_components(spark, d):
    li = read_table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    p = prepare.setup(li, ignore=["l_orderkey", "l_linenumber"], normalize="robust", components=0.8)
    return r6(p.transform(li, ["l_orderkey", "l_linenumber"]), 4)


@query
def feat_quantile_normal(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return r6(prepare.setup(o, numeric=["o_totalprice"], ignore=["o_orderkey"], transformation="quantile-normal").transform(o, ["o_orderkey"]), 4)


@query
def outlier_ensemble(spark, d):
    return ensemble.detect(_events(spark, d), "event_id", ["value", "user_id"])["rows"]


@query
def outlier_impact(spark, d):
    o = _orders(spark, d)
    rows = ensemble.detect(o, "o_orderkey", ["price", "noise"], ("iqr", "zscore"))["rows"]
    return r6(ensemble.impact(o, "o_orderkey", "y", rows, FEATS, trees=10, depth=5), 3)


@query
def leak_table_report(spark, d):
    """All findings of one table; copies of the price and a date ahead of its time are planted."""
    o = read_table(spark, d, "orders").selectExpr("o_orderkey", "o_totalprice AS price", "o_totalprice * 2 AS double_price", "o_orderstatus AS status", "o_orderstatus AS status_result", "date_add(o_orderdate, 20000) AS shipped", "1 AS flat")
    return r6(leakage_report.table_report(o, "status", "2020-01-01")["findings"], 3)


@query
def dim_pca_loadings(spark, d):
    li = read_table(spark, d, "lineitem").selectExpr(*COLS, "l_extendedprice * (1 - l_discount) AS net")
    return r6(linear.principal(li, [*COLS, "net"])["loadings"], 3)


@query
def dim_pca_places(spark, d):
    li = read_table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS row_key", *COLS, "l_extendedprice * (1 - l_discount) AS net")
    return r6(linear.principal(li, [*COLS, "net"])["place"](li, "row_key", 3), 3)
