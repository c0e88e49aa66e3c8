"""Profile, missingness, outlier, drift, leakage, fairness and time-series queries."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, fairness, leakage, missing, outlier, profile, timeseries
from ..session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r6(df: DataFrame, digits: int = 6, **each: int) -> DataFrame:
    """Doubles rounded, so that the last bit of a sum does not matter."""
    return df.select(*((F.round(F.col(c), each.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def rnd(expr: str, alias: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {alias}"


# --- profile ---------------------------------------------------------------------------------------------------------


def _summary_sql(table: str, cols: list[str]) -> str:
    return union(
        f"""SELECT '{c}' AS feature, count({c}) AS n, {rnd(f'avg({c})', 'mean')}, {rnd(f'quantile_cont({c}::DOUBLE, 0.5)', 'median')}, {rnd(f'stddev_samp({c})', 'std')}, {rnd(f'var_samp({c})', 'var', 4)},
        {rnd(f'min({c})::DOUBLE', 'min_value')}, {rnd(f'max({c})::DOUBLE', 'max_value')}, {rnd(f'quantile_cont({c}::DOUBLE, 0.25)', 'q25')}, {rnd(f'quantile_cont({c}::DOUBLE, 0.75)', 'q75')},
        {rnd(f'skewness({c})', 'skew')}, {rnd(f'kurtosis({c})', 'kurtosis')}, {rnd(f'(max({c}) - min({c}))::DOUBLE', 'value_range')},
        {rnd(f'quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)', 'iqr')}, {rnd(f'stddev_samp({c}) / avg({c})', 'cv')} FROM {table}"""
        for c in cols
    )


@query("profile_numeric_summary", _summary_sql("lineitem", LINE))
def profile_numeric_summary(spark, d):
    return r6(profile.numeric_summary(read_table(spark, d, "lineitem"), LINE), var=4)


@query("profile_skew_interpretation", union(f"SELECT '{c}' AS feature, {rnd(f'skewness({c})', 'skew')}, CASE WHEN abs(skewness({c})) < 0.5 THEN 'approximately symmetric' WHEN abs(skewness({c})) < 1 THEN 'moderately skewed' ELSE 'highly skewed' END AS interpretation, CASE WHEN abs(skewness({c})) < 0.5 THEN 'none' WHEN skewness({c}) > 0 THEN 'right' ELSE 'left' END AS tail FROM {t}" for t, c in (("events", "value"),)))
def profile_skew_interpretation(spark, d):
    return r6(profile.skew_interpretation(profile.numeric_summary(read_table(spark, d, "events"), ["value"])))


def _counts_sql(table: str, cols: list[str]) -> str:
    return union(f"SELECT '{c}' AS feature, {c}::VARCHAR AS value, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols)


ORDER_CATS = ["o_orderstatus", "o_orderpriority"]


@query("profile_categorical", f"""
WITH c AS ({_counts_sql('orders', ORDER_CATS)}),
a AS (SELECT feature, sum(n)::BIGINT AS n, count(*) AS n_unique FROM c GROUP BY feature),
t AS (SELECT feature, value, n, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS hi, row_number() OVER (PARTITION BY feature ORDER BY n, value) AS lo FROM c)
SELECT a.feature, a.n, n_unique, h.value AS most_frequent, h.n AS most_count, l.value AS least_frequent, l.n AS least_count, round(n_unique / a.n, 6) AS cardinality_ratio,
CASE WHEN n_unique / a.n <= 0.5 THEN 'low' WHEN n_unique / a.n <= 0.9 THEN 'high' ELSE 'identifier' END AS cardinality
FROM a JOIN t h ON h.feature = a.feature AND h.hi = 1 JOIN t l ON l.feature = a.feature AND l.lo = 1""")
def profile_categorical(spark, d):
    return r6(profile.categorical_summary(read_table(spark, d, "orders"), ORDER_CATS))


@query("profile_top_values", f"SELECT feature, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value)::INT AS rank FROM ({_counts_sql('part', ['p_brand', 'p_type'])})) WHERE rank <= 10")
def profile_top_values(spark, d):
    return profile.top_values(profile.value_counts(read_table(spark, d, "part"), ["p_brand", "p_type"]))


@query("target_profile", _summary_sql("orders", ["o_totalprice"]))
def target_profile(spark, d):
    return r6(profile.numeric_summary(read_table(spark, d, "orders"), ["o_totalprice"]), var=4)


@query("class_balance", """
WITH c AS (SELECT o_orderstatus AS class, count(*) AS n FROM orders GROUP BY 1)
SELECT class, n, round(n / sum(n) OVER (), 6) AS share, round(max(n) OVER () / min(n) OVER (), 6) AS imbalance_ratio,
CASE WHEN max(n) OVER () / min(n) OVER () < 1.5 THEN 'Balanced' WHEN max(n) OVER () / min(n) OVER () < 4 THEN 'Slightly Imbalanced' WHEN max(n) OVER () / min(n) OVER () < 10 THEN 'Moderately Imbalanced' ELSE 'Highly Imbalanced' END AS balance FROM c""")
def class_balance(spark, d):
    return r6(profile.class_balance(read_table(spark, d, "orders"), "o_orderstatus"))


@query("fq_variance", union(f"SELECT '{c}' AS feature, round(var_samp({c}), 4) AS variance, var_samp({c}) < 0.01 AS is_low FROM lineitem" for c in LINE))
def fq_variance(spark, d):
    return r6(profile.variances(read_table(spark, d, "lineitem"), LINE), 4)


PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
_PART_TEXT = {"p_name", "p_brand", "p_type"}


@query("fq_cardinality", union(f"""SELECT '{c}' AS feature, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, round(count(DISTINCT {c}) / count(*), 6) AS ratio,
CASE WHEN {'TRUE' if c not in _PART_TEXT else 'FALSE'} THEN 'none' WHEN count(DISTINCT {c}) / count(*) > 0.8 THEN 'id_like' WHEN count(DISTINCT {c}) > 100 THEN 'high' ELSE 'none' END AS cardinality_issue FROM part""" for c in PART_COLS))
def fq_cardinality(spark, d):
    return r6(profile.cardinalities(read_table(spark, d, "part"), PART_COLS))


CONST = ["l_quantity", "l_returnflag", "l_linestatus", "one", "mostly"]
_CONST_SQL = "(SELECT *, 1 AS one, CASE WHEN l_orderkey % 50 = 0 THEN 'b' ELSE 'a' END AS mostly FROM lineitem)"


@query("leak_constant", f"""
WITH c AS ({_counts_sql(_CONST_SQL, CONST)}), t AS (SELECT count(*) AS n_rows FROM lineitem),
a AS (SELECT feature, count(*) AS n_unique, max(n) AS top FROM c GROUP BY feature)
SELECT feature, n_rows, n_unique, round(top / n_rows, 6) AS top_share, CASE WHEN n_unique <= 1 THEN 'constant' WHEN top / n_rows >= 0.95 THEN 'quasi_constant' WHEN n_unique / n_rows < 0.01 THEN 'low_uniqueness' ELSE 'none' END AS flag FROM a, t""")
def leak_constant(spark, d):
    df = read_table(spark, d, "lineitem").selectExpr("*", "1 AS one", "CASE WHEN l_orderkey % 50 = 0 THEN 'b' ELSE 'a' END AS mostly")
    return r6(profile.constants(df, CONST))


_NET = "l_extendedprice * (1 - l_discount)"
REDUNDANT = ["l_quantity", "l_extendedprice", "l_tax", "net", "gross"]
_RED_SQL = f"(SELECT *, {_NET} AS net, {_NET} * (1 + l_tax) AS gross FROM lineitem)"


def _redundant(spark, d):
    return read_table(spark, d, "lineitem").selectExpr("*", f"{_NET} AS net", f"{_NET} * (1 + l_tax) AS gross")


@query("fq_redundant_pairs", "SELECT * FROM (" + union(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr({a}, {b}), 6) AS r FROM {_RED_SQL}" for a, b in combinations(REDUNDANT, 2)) + ") WHERE abs(r) >= 0.8")
def fq_redundant_pairs(spark, d):
    return r6(profile.correlations(_redundant(spark, d), REDUNDANT, 0.8))


@query("profile_correlations", union(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem" for a, b in combinations(LINE, 2)))
def profile_correlations(spark, d):
    return r6(profile.correlations(read_table(spark, d, "lineitem"), LINE))


@query("fq_crosstab", "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def fq_crosstab(spark, d):
    return profile.crosstab(read_table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


def _chi2_sql(cells: str) -> str:
    return f"""WITH c AS ({cells}), t AS (SELECT sum(n) AS total, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM c),
g AS (SELECT a, b, na * nb / total AS e, total, ka, kb FROM (SELECT a, sum(n) AS na FROM c GROUP BY a), (SELECT b, sum(n) AS nb FROM c GROUP BY b), t),
x AS (SELECT e, abs(coalesce(n, 0) - e) AS gap, total, ka, kb FROM g LEFT JOIN c USING (a, b))
SELECT round(sum(CASE WHEN ka = 2 AND kb = 2 THEN power(gap - least(0.5, gap), 2) ELSE gap * gap END / e), 6) AS chi2, ((max(ka) - 1) * (max(kb) - 1))::BIGINT AS dof, max(total)::BIGINT AS n FROM x"""


@query("fq_chi2", _chi2_sql("SELECT event_type AS a, (user_id % 7)::VARCHAR AS b, count(*) AS n FROM events GROUP BY 1, 2"))
def fq_chi2(spark, d):
    df = read_table(spark, d, "events").selectExpr("event_type", "user_id % 7 AS u")
    return r6(profile.chi_square(profile.crosstab(df, "event_type", "u")))


@query("profile_jarque_bera", """
WITH m AS (SELECT avg(value) AS a FROM events), s AS (SELECT count(*) AS n, avg(power(value - a, 2)) AS m2, avg(power(value - a, 3)) AS m3, avg(power(value - a, 4)) AS m4 FROM events, m)
SELECT 'value' AS feature, n, round(n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 4) AS jarque_bera, round(exp(-(n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4)) / 2), 6) AS p_value FROM s""")
def profile_jarque_bera(spark, d):
    return r6(profile.normality(read_table(spark, d, "events"), ["value"]), jarque_bera=4)


DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@query("fq_types", union(f"""SELECT '{c}' AS feature, {"'numeric'" if c in ('doc_id', 'n_chars') else f"CASE WHEN avg(length({c}::VARCHAR)) > 50 OR count(DISTINCT {c}) / count({c}) > 0.8 THEN 'text' ELSE 'categorical' END"} AS feature_type,
count(DISTINCT {c}) AS n_unique, round(count(DISTINCT {c}) / count({c}), 6) AS unique_ratio, {'NULL::DOUBLE' if c in ('doc_id', 'n_chars') else f'round(avg(length({c})), 6)'} AS avg_length FROM documents""" for c in DOC_COLS))
def fq_types(spark, d):
    return r6(profile.type_profile(read_table(spark, d, "documents"), DOC_COLS))


@query("fq_type_consistency", """
SELECT 'num_text' AS feature, 'categorical' AS stored, count(*) AS n, 0.0::DOUBLE AS numeric_loss, 1.0::DOUBLE AS date_loss, FALSE AS whole, 'numeric_as_text' AS type_issue FROM lineitem
UNION ALL SELECT 'date_text', 'categorical', count(*), 1.0, 0.0, FALSE, 'datetime_as_text' FROM lineitem
UNION ALL SELECT 'l_quantity_d', 'numeric', count(*), NULL, NULL, bool_and(l_quantity::DOUBLE % 1 = 0), CASE WHEN bool_and(l_quantity::DOUBLE % 1 = 0) THEN 'integer_as_float' ELSE 'none' END FROM lineitem
UNION ALL SELECT 'l_returnflag', 'categorical', count(*), 1.0, 1.0, FALSE, 'none' FROM lineitem""")
def fq_type_consistency(spark, d):
    df = read_table(spark, d, "lineitem").selectExpr("concat(cast(l_tax as string), 'e0') AS num_text", "date_format(l_shipdate, 'yyyy-MM-dd') AS date_text", "cast(l_quantity as double) AS l_quantity_d", "l_returnflag")
    return profile.type_consistency(df, df.columns)


@query("id_detection", union(f"""SELECT '{c}' AS feature, round(count(DISTINCT {c}) / count({c}), 6) AS unique_ratio, {'TRUE' if c.endswith('key') else 'FALSE'} AS named, min(length({c}::VARCHAR)) = max(length({c}::VARCHAR)) AND min(length({c}::VARCHAR)) >= 8 AS fixed, 0.0::DOUBLE AS uuid_share,
count(DISTINCT {c}) / count({c}) >= 0.9 OR ({'TRUE' if c.endswith('key') else 'FALSE'} AND count(DISTINCT {c}) / count({c}) > 0.5) OR (min(length({c}::VARCHAR)) = max(length({c}::VARCHAR)) AND min(length({c}::VARCHAR)) >= 8 AND count(DISTINCT {c}) / count({c}) > 0.5) AS id_like FROM customer""" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def id_detection(spark, d):
    return r6(profile.id_columns(read_table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))


_CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("validate_data", f"""
WITH u AS (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey % 10 = 0)
SELECT 'rows' AS metric, count(*)::BIGINT AS value FROM u UNION ALL SELECT 'columns', {len(_CUST)} UNION ALL SELECT 'duplicate_rows', (SELECT count(*) FROM u) - (SELECT count(*) FROM (SELECT DISTINCT * FROM u))
""" + "".join(f"UNION ALL SELECT 'missing:{c}', count(*) - count({c}) FROM u UNION ALL SELECT 'all_null:{c}', (count({c}) = 0)::BIGINT FROM u " for c in _CUST))
def validate_data(spark, d):
    df = read_table(spark, d, "customer")
    return profile.validate(df.union(df.where("c_custkey % 10 = 0")))


@query("advisor", f"""
WITH n AS (SELECT *, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_discount END AS gap, {_NET} AS net, exp(l_quantity / 10.0) AS grown, row_number() OVER () AS rid FROM lineitem)
SELECT 'gap' AS feature, 'missing' AS advice, CASE WHEN (count(*) - count(gap)) / count(*) >= 0.2 THEN 'critical' ELSE 'important' END AS level FROM n
UNION ALL SELECT 'grown', 'skewed', 'moderate' FROM n HAVING abs(skewness(grown)) > 1
UNION ALL SELECT 'l_extendedprice~net', 'correlated', 'important' FROM n HAVING corr(l_extendedprice, net) >= 0.95
UNION ALL SELECT 'l_extendedprice', 'identifier', 'moderate' FROM n HAVING count(DISTINCT l_extendedprice) / count(*) > 0.9
UNION ALL SELECT 'net', 'identifier', 'moderate' FROM n HAVING count(DISTINCT net) / count(*) > 0.9""")
def advisor(spark, d):
    df = read_table(spark, d, "lineitem").selectExpr("l_extendedprice", "CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_discount END AS gap", f"{_NET} AS net", "exp(l_quantity / 10.0) AS grown", "l_returnflag")
    return profile.advise(df)


# --- missingness -----------------------------------------------------------------------------------------------------

_GAPS = {
    "l_orderkey": "l_orderkey", "l_quantity": "l_quantity", "l_tax": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END", "l_discount": "CASE WHEN l_orderkey % 14 = 0 THEN NULL ELSE l_discount END",
    "l_extendedprice": "CASE WHEN l_quantity > 40 AND l_orderkey % 3 = 0 THEN NULL ELSE l_extendedprice END", "l_comment_code": "CASE WHEN l_orderkey % 5 <> 0 THEN NULL ELSE l_linestatus END",
}
_GAP_COLS = list(_GAPS)
_GAP_SQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _GAPS.items()) + " FROM lineitem)"


def _gappy(spark, d):
    return read_table(spark, d, "lineitem").selectExpr(*(f"{e} AS {c}" for c, e in _GAPS.items()))


@query("missing_by_column", union(f"SELECT '{c}' AS feature, count(*) AS n_rows, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*) * 100, 6) AS missing_pct, (count(*) - count({c})) / count(*) * 100 >= 50 AS high FROM {_GAP_SQL}" for c in _GAP_COLS))
def missing_by_column(spark, d):
    return r6(missing.by_column(_gappy(spark, d)))


_BITS = " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in _GAP_COLS)


@query("missing_patterns", f"SELECT pattern, n, round(n / (SELECT count(*) FROM lineitem) * 100, 6) AS share_pct FROM (SELECT {_BITS} AS pattern, count(*) AS n FROM {_GAP_SQL} GROUP BY 1) ORDER BY n DESC, pattern LIMIT 10")
def missing_patterns(spark, d):
    return r6(missing.patterns(_gappy(spark, d)))


@query("missing_pattern_mining", f"SELECT pattern, n, round(n / (SELECT count(*) FROM lineitem) * 100, 6) AS share_pct FROM (SELECT {_BITS} AS pattern, count(*) AS n FROM {_GAP_SQL} GROUP BY 1) WHERE pattern LIKE '%1%' ORDER BY n DESC, pattern LIMIT 20")
def missing_pattern_mining(spark, d):
    return r6(missing.patterns(_gappy(spark, d), k=20, only_missing=True))


@query("missing_indicator_corr", "SELECT * FROM (" + union(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr(({a} IS NULL)::INT, ({b} IS NULL)::INT), 6) AS r FROM {_GAP_SQL}" for a, b in combinations(_GAP_COLS[2:], 2)) + ") WHERE abs(r) > 0.5")
def missing_indicator_corr(spark, d):
    return r6(missing.indicator_correlations(_gappy(spark, d), _GAP_COLS))


_COUNT = " + ".join(f"({c} IS NULL)::INT" for c in _GAP_COLS)


@query("missing_per_row", f"SELECT count(*) FILTER (m > 0) AS rows_any, count(*) FILTER (m = {len(_GAP_COLS)}) AS rows_all, max(m)::BIGINT AS max_missing, round(avg(m), 6) AS avg_missing FROM (SELECT {_COUNT} AS m FROM {_GAP_SQL})")
def missing_per_row(spark, d):
    return r6(missing.per_row(_gappy(spark, d)))


@query("target_missing_cross", union(f"SELECT '{c}' AS feature, count(*) FILTER (l_tax IS NULL) AS n_target_missing, count(*) FILTER (l_tax IS NULL AND {c} IS NULL) AS n_both, round(count(*) FILTER (l_tax IS NULL AND {c} IS NULL) / count(*) FILTER (l_tax IS NULL) * 100, 6) AS pct_given_target_missing FROM {_GAP_SQL}" for c in _GAP_COLS if c != "l_tax"))
def target_missing_cross(spark, d):
    return r6(missing.target_cross(_gappy(spark, d), "l_tax", [c for c in _GAP_COLS if c != "l_tax"]))


@query("completeness_score", "WITH m AS (" + union(f"SELECT '{c}' AS f, count(*) - count({c}) AS x, count(*) AS n FROM {_GAP_SQL}" for c in _GAP_COLS) + """), a AS (SELECT sum(x) / sum(n) * 100 AS o, count(*) FILTER (x / n * 100 >= 50) / count(*) AS high, max(CASE WHEN f = 'l_tax' THEN x / n * 100 END) AS t, count(*) FILTER (x > 0) / count(*) AS gaps FROM m)
SELECT round(o, 6) AS overall_missing_pct, round(least(greatest(100 - o - 30 * high - least(t / 2, 20) + CASE WHEN gaps < 0.1 THEN 5 ELSE 0 END, 0), 100), 2) AS score FROM a""")
def completeness_score(spark, d):
    return r6(missing.score(_gappy(spark, d), "l_tax"))


@query("missing_recommendations", "SELECT feature, round(p, 6) AS missing_pct, CASE WHEN p <= 5 THEN 'mean or mode' WHEN p <= 20 THEN 'nearest neighbours' WHEN p <= 50 THEN 'model-based' ELSE 'drop the column' END AS recommendation FROM (" + union(f"SELECT '{c}' AS feature, (count(*) - count({c})) / count(*) * 100 AS p FROM {_GAP_SQL}" for c in _GAP_COLS) + ") WHERE p > 0")
def missing_recommendations(spark, d):
    return r6(missing.recommendations(missing.by_column(_gappy(spark, d))))


def _impact_sql(c: str, m: str, fill: str) -> str:
    x = f"coalesce({c}, v)"
    return f"""SELECT '{c}' AS feature, '{m}' AS method, round(any_value(v), 6) + 0.0 AS fill, {rnd(f'avg({x}) - avg({c})', 'mean_delta')}, {rnd(f'stddev_samp({x}) - stddev_samp({c})', 'std_delta')},
{rnd(f'quantile_cont({x}, 0.5) - quantile_cont({c}, 0.5)', 'median_delta')}, {rnd(f'skewness({x}) - skewness({c})', 'skew_delta')} FROM {_GAP_SQL}, (SELECT ({fill})::DOUBLE AS v)"""


@query("imputation_impact", union(_impact_sql(c, m, f) for c in ("l_tax", "l_extendedprice") for m, f in (("mean", f"SELECT avg({c}) FROM {_GAP_SQL}"), ("median", f"SELECT quantile_cont({c}, 0.5) FROM {_GAP_SQL}"), ("mode", f"SELECT {c} FROM {_GAP_SQL} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1"))))
def imputation_impact(spark, d):
    return r6(missing.imputation_impact(_gappy(spark, d), ["l_tax", "l_extendedprice"]))


@query("mcar_ttest_stats", "SELECT feature, n AS n_missing, m AS n_present, round((a - b) / sqrt(((n - 1) * va + (m - 1) * vb) / (n + m - 2) * (1.0 / n + 1.0 / m)), 6) AS t_stat FROM (" + union(f"SELECT '{c}' AS feature, count({c}) FILTER (l_extendedprice IS NULL) AS n, count({c}) FILTER (l_extendedprice IS NOT NULL) AS m, avg({c}) FILTER (l_extendedprice IS NULL) AS a, avg({c}) FILTER (l_extendedprice IS NOT NULL) AS b, var_samp({c}) FILTER (l_extendedprice IS NULL) AS va, var_samp({c}) FILTER (l_extendedprice IS NOT NULL) AS vb FROM {_GAP_SQL}" for c in ("l_quantity", "l_tax", "l_discount")) + ")")
def mcar_ttest_stats(spark, d):
    return r6(missing.ttest_stats(_gappy(spark, d), "l_extendedprice", ["l_quantity", "l_tax", "l_discount"]))


@query("mcar_chi2_stats", _chi2_sql(f"SELECT (l_extendedprice IS NULL)::VARCHAR AS a, least(floor((l_quantity - lo) / ((hi - lo) / 5.0)), 4)::VARCHAR AS b, count(*) AS n FROM {_GAP_SQL}, (SELECT min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi FROM lineitem) GROUP BY 1, 2"))
def mcar_chi2_stats(spark, d):
    return r6(missing.chi2_stats(_gappy(spark, d), "l_extendedprice", "l_quantity"))


# --- outliers --------------------------------------------------------------------------------------------------------


def _fence_sql(table: str, c: str, by: str = "") -> str:
    return f"SELECT {by}quantile_cont({c}::DOUBLE, 0.25) - 1.5 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) AS lo, quantile_cont({c}::DOUBLE, 0.75) + 1.5 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) AS hi FROM {table}"


@query("outlier_iqr", f"SELECT 'value' AS feature, {rnd('lo', 'lower')}, {rnd('hi', 'upper')}, count(*) FILTER (value < lo OR value > hi) AS n_outliers, round(count(*) FILTER (value < lo OR value > hi) / count(value) * 100, 6) AS outlier_pct FROM events, ({_fence_sql('events', 'value')}) GROUP BY lo, hi")
def outlier_iqr(spark, d):
    return r6(outlier.iqr_outliers(read_table(spark, d, "events"), ["value"]))


@query("outlier_zscore", "SELECT 'value' AS feature, count(*) AS n, count(*) FILTER (abs(value - m) / s > 3) AS n_outliers, round(count(*) FILTER (abs(value - m) / s > 3) / count(*) * 100, 6) AS outlier_pct, round(max(abs(value - m) / s), 6) AS max_z FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)")
def outlier_zscore(spark, d):
    return r6(outlier.zscore_outliers(read_table(spark, d, "events"), ["value"]))


@query("outlier_modified_z", "WITH a AS (SELECT quantile_cont(value, 0.5) AS md FROM events), b AS (SELECT quantile_cont(abs(value - md), 0.5) AS mad FROM events, a) SELECT 'value' AS feature, round(md, 6) AS median_value, round(mad, 6) AS mad, count(*) FILTER (abs(0.6745 * (value - md) / mad) > 3.5) AS n_outliers FROM events, a, b GROUP BY md, mad")
def outlier_modified_z(spark, d):
    return r6(outlier.modified_z_outliers(read_table(spark, d, "events"), ["value"]))


@query("outlier_consensus", f"SELECT event_id, i AS by_iqr, z AS by_zscore, i::INT + z::INT AS votes, i::INT + z::INT >= 1 AS is_outlier FROM (SELECT event_id, value < lo OR value > hi AS i, abs(value - m) / s > 3 AS z FROM events, ({_fence_sql('events', 'value')}), (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events))")
def outlier_consensus(spark, d):
    return outlier.consensus(read_table(spark, d, "events"), ["event_id"], ["value"])


@query("outlier_context", f"SELECT 'value' AS feature, event_type AS context, {rnd('lo', 'lower')}, {rnd('hi', 'upper')}, count(*) FILTER (value < lo OR value > hi) AS n_outliers FROM events JOIN ({_fence_sql('events', 'value', 'event_type, ')} GROUP BY event_type) USING (event_type) GROUP BY event_type, lo, hi HAVING count(*) >= 10")
def outlier_context(spark, d):
    return r6(outlier.by_context(read_table(spark, d, "events"), ["value"], "event_type"))


@query("outlier_explain", "WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events), z AS (SELECT event_id AS row_key, value AS x, (value - m) / s AS z FROM events, s), t AS (SELECT * FROM z WHERE abs(z) > 2 ORDER BY abs(z) DESC, row_key LIMIT 50) SELECT row_key, round(x, 6) AS x, round(z, 6) AS z, round((SELECT count(*) FROM events WHERE value < t.x) / (SELECT count(*) FROM events) * 100, 6) AS percentile, CASE WHEN abs(z) < 3 THEN 'low' WHEN abs(z) < 4 THEN 'medium' WHEN abs(z) < 5 THEN 'high' ELSE 'extreme' END AS severity FROM t")
def outlier_explain(spark, d):
    return r6(outlier.explain(read_table(spark, d, "events"), "event_id", "value"))


# --- drift -----------------------------------------------------------------------------------------------------------

_HALF = "TIMESTAMP '2024-01-16'"
_B, _C = f"(SELECT value AS x, event_type AS v FROM events WHERE ts < {_HALF})", f"(SELECT value * 1.1 AS x, CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'tap' ELSE event_type END AS v FROM events WHERE ts >= {_HALF})"


def _halves(spark, d):
    e = read_table(spark, d, "events")
    base = e.where("ts < timestamp_ntz '2024-01-16'").selectExpr("value AS x", "event_type AS v")
    return base, e.where("ts >= timestamp_ntz '2024-01-16'").selectExpr("value * 1.1 AS x", "CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'tap' ELSE event_type END AS v")


_DECILES = ", ".join(f"quantile_cont(x, {i / 10})" for i in range(1, 10))


@query("drift_psi", f"""WITH e AS (SELECT [{_DECILES}] AS q FROM {_B}), b AS (SELECT len(list_filter(q, lambda z: z < x)) AS bin, count(*) AS n FROM {_B}, e GROUP BY 1), c AS (SELECT len(list_filter(q, lambda z: z < x)) AS bin, count(*) AS n FROM {_C}, e GROUP BY 1),
s AS (SELECT coalesce(b.n, 0) / (SELECT sum(n) FROM b) + 1e-10 AS p, coalesce(c.n, 0) / (SELECT sum(n) FROM c) + 1e-10 AS r FROM range(10) g(i) LEFT JOIN b ON b.bin = i LEFT JOIN c ON c.bin = i)
SELECT 'x' AS feature, round(sum((r - p) * ln(r / p)), 6) AS psi, count(*) AS n_bins, sum((r - p) * ln(r / p)) > 0.2 AS drift FROM s""")
def drift_psi(spark, d):
    return r6(drift.psi(*_halves(spark, d), "x"))


@query("drift_ks_stat", f"""WITH u AS (SELECT x, 1 AS b, 0 AS c FROM {_B} UNION ALL SELECT x, 0, 1 FROM {_C}), g AS (SELECT x, sum(b) AS b, sum(c) AS c FROM u GROUP BY x),
k AS (SELECT sum(b) OVER (ORDER BY x) / (SELECT sum(b) FROM g) - sum(c) OVER (ORDER BY x) / (SELECT sum(c) FROM g) AS d FROM g)
SELECT 'x' AS feature, round(max(abs(d)), 6) AS ks_stat, (SELECT sum(b)::BIGINT FROM g) AS n_baseline, (SELECT sum(c)::BIGINT FROM g) AS n_current FROM k""")
def drift_ks_stat(spark, d):
    return r6(drift.ks(*_halves(spark, d), "x"))


@query("drift_js_numeric", f"""WITH u AS (SELECT x, 1 AS b FROM {_B} UNION ALL SELECT x, 0 FROM {_C}), r AS (SELECT min(x) AS lo, max(x) AS hi FROM u),
h AS (SELECT least(floor((x - lo) / ((hi - lo) / 50)), 49)::INT AS bin, sum(b) AS nb, sum(1 - b) AS nc FROM u, r GROUP BY 1),
s AS (SELECT coalesce(nb, 0) / (SELECT sum(nb) FROM h) + 1e-10 AS p, coalesce(nc, 0) / (SELECT sum(nc) FROM h) + 1e-10 AS c FROM range(50) g(i) LEFT JOIN h ON bin = i),
n AS (SELECT p / sum(p) OVER () AS p, c / sum(c) OVER () AS c FROM s)
SELECT 'x' AS feature, round(sqrt(sum(p * ln(p / ((p + c) / 2)) + c * ln(c / ((p + c) / 2))) / 2), 6) AS js_distance, sqrt(sum(p * ln(p / ((p + c) / 2)) + c * ln(c / ((p + c) / 2))) / 2) > 0.1 AS drift FROM n""")
def drift_js_numeric(spark, d):
    return r6(drift.js_numeric(*_halves(spark, d), "x"))


_CATS = f"WITH b AS (SELECT v, count(*) AS n FROM {_B} GROUP BY 1), c AS (SELECT v, count(*) AS n FROM {_C} GROUP BY 1), f AS (SELECT coalesce(b.v, c.v) AS value, coalesce(b.n, 0) AS base, coalesce(c.n, 0) AS cur FROM b FULL JOIN c ON b.v = c.v), t AS (SELECT sum(base) AS nb, sum(cur) AS nc, sum(base + 1) AS se, sum(cur + 1) AS so FROM f)"


@query("drift_chi2", f"{_CATS} SELECT 'v' AS feature, round(sum(power(cur + 1 - (base + 1) * so / se, 2) / ((base + 1) * so / se)), 6) AS chi2, count(*) - 1 AS dof FROM f, t")
def drift_chi2(spark, d):
    return r6(drift.chi2(*_halves(spark, d), "v"))


_JSC = "sqrt(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + c) / 2)) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c / ((p + c) / 2)) ELSE 0 END) / 2)"


@query("drift_js_categorical", f"{_CATS} SELECT 'v' AS feature, round({_JSC}, 6) AS js_distance, {_JSC} > 0.1 AS drift FROM (SELECT base / nb AS p, cur / nc AS c FROM f, t)")
def drift_js_categorical(spark, d):
    return r6(drift.js_categorical(*_halves(spark, d), "v"))


@query("drift_new_categories", f"{_CATS} SELECT 'v' AS feature, value, CASE WHEN base = 0 THEN 'new' ELSE 'missing' END AS change FROM f WHERE base = 0 OR cur = 0")
def drift_new_categories(spark, d):
    return drift.category_changes(*_halves(spark, d), "v")


@query("drift_stats", union(f"SELECT '{s}' AS side, 'x' AS feature, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(quantile_cont(x, 0.5), 6) AS median, round(min(x), 6) AS min_value, round(max(x), 6) AS max_value FROM {t}" for s, t in (("baseline", _B), ("current", _C))))
def drift_stats(spark, d):
    return r6(drift.side_stats(*_halves(spark, d), ["x"]))


@query("concept_drift", f"{_CATS} SELECT value, round(base / nb, 6) AS baseline_share, round(cur / nc, 6) AS current_share, round(abs(cur / nc - base / nb), 6) AS change, abs(cur / nc - base / nb) > 0.1 AS drift FROM f, t")
def concept_drift(spark, d):
    return r6(drift.concept(*_halves(spark, d), "v"))


# --- leakage ---------------------------------------------------------------------------------------------------------

_TEST = "(SELECT * FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 5 = 1 AND o_orderkey % 100 = 1)"


def _split(spark, d):
    o = read_table(spark, d, "orders")
    return o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 5 = 0 OR o_orderkey % 100 = 1")


@query("leak_contamination", f"SELECT count(*) AS n_test, count(*) FILTER (hit) AS n_contaminated, round(count(*) FILTER (hit) / count(*) * 100, 6) AS rate_pct, CASE WHEN count(*) FILTER (hit) > 0 THEN 'critical' ELSE 'none' END AS severity FROM (SELECT (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) IN (SELECT (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) FROM orders WHERE o_orderkey % 5 <> 0) AS hit FROM {_TEST})")
def leak_contamination(spark, d):
    return r6(leakage.contamination(*_split(spark, d)))


@query("leak_group_overlap", f"WITH a AS (SELECT DISTINCT o_custkey AS e FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT DISTINCT o_custkey AS e FROM {_TEST}), o AS (SELECT (SELECT count(*) FROM a) AS n_train, (SELECT count(*) FROM b) AS n_test, (SELECT count(*) FROM a JOIN b USING (e)) AS n_overlap) SELECT n_train, n_test, n_overlap, round(n_overlap / n_test * 100, 6) AS overlap_pct, CASE WHEN n_overlap = 0 THEN 'none' WHEN n_overlap / n_test * 100 <= 20 THEN 'medium' WHEN n_overlap / n_test * 100 <= 50 THEN 'high' ELSE 'critical' END AS severity FROM o")
def leak_group_overlap(spark, d):
    return r6(leakage.group_overlap(*_split(spark, d), "o_custkey"))


_WIDE = "o_orderkey, o_custkey, o_totalprice, o_totalprice * 2 + o_custkey % 7 AS leak, o_orderstatus"
_TOLD = f"tr AS (SELECT {_WIDE} FROM orders WHERE o_orderkey % 5 <> 0), te AS (SELECT {_WIDE} FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 100 = 1)"


@query("leak_detect_all", f"""WITH {_TOLD}, g AS (SELECT (SELECT count(DISTINCT o_custkey) FROM te) AS n, (SELECT count(DISTINCT o_custkey) FROM te WHERE o_custkey IN (SELECT o_custkey FROM tr)) AS k)
SELECT 'train_test_contamination' AS type, 'critical' AS severity, '' AS features WHERE EXISTS (SELECT 1 FROM te JOIN tr USING (o_orderkey, o_custkey, o_totalprice, o_orderstatus))
UNION ALL SELECT 'group_leakage', CASE WHEN k / n * 100 <= 20 THEN 'medium' WHEN k / n * 100 <= 50 THEN 'high' ELSE 'critical' END, 'o_custkey' FROM g WHERE k > 0
UNION ALL SELECT 'target_leakage', 'critical', c FROM (""" + union(f"SELECT '{c}' AS c, corr({c}, o_totalprice) AS r FROM tr" for c in ("o_orderkey", "o_custkey", "leak")) + ") WHERE abs(r) >= 0.95")
def leak_detect_all(spark, d):
    train, test = (x.selectExpr(*_WIDE.split(", ")) for x in _split(spark, d))
    found = leakage.detect_all(train, test, "o_totalprice", "o_custkey")
    return found.select("type", "severity", F.array_join("features", ",").alias("features"))


_SHIFT = {"o_custkey": "o_custkey", "o_totalprice": "o_totalprice * 1.2", "month": "month(o_orderdate)"}


@query("leak_shift_ranked", "WITH " + ", ".join(f"""{c}_u AS (SELECT {'month(o_orderdate)' if c == 'month' else c} AS x, 1 AS b, 0 AS c FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT {e}, 0, 1 FROM orders WHERE o_orderkey % 5 = 0),
{c}_g AS (SELECT x, sum(b) AS b, sum(c) AS c FROM {c}_u GROUP BY x), {c}_n AS (SELECT sum(b) AS n, sum(c) AS m FROM {c}_g),
{c}_k AS (SELECT max(abs(d)) AS d FROM (SELECT sum(b) OVER (ORDER BY x) / n - sum(c) OVER (ORDER BY x) / m AS d FROM {c}_g, {c}_n))""" for c, e in _SHIFT.items()) + "\nSELECT feature, round(d, 6) AS ks_stat, row_number() OVER (ORDER BY d DESC, feature) AS rank FROM (" + union(f"SELECT '{c}' AS feature, d, d * sqrt(n * m / (n + m)) AS t FROM {c}_k, {c}_n" for c in _SHIFT) + ") WHERE t > 1.949474")
def leak_shift_ranked(spark, d):
    o = read_table(spark, d, "orders")
    train = o.where("o_orderkey % 5 <> 0").selectExpr("o_custkey", "o_totalprice", "month(o_orderdate) AS month")
    test = o.where("o_orderkey % 5 = 0").selectExpr(*(f"{e} AS {c}" for c, e in _SHIFT.items()))
    return r6(leakage.ranked_shift(train, test, list(_SHIFT))).select("feature", "ks_stat", F.col("rank").cast("long").alias("rank"))


@query("leak_perfect_corr", "SELECT feature_1, feature_2, round(r, 6) AS r, CASE WHEN abs(r) >= 0.99 THEN 'Critical' ELSE 'High' END AS severity FROM (" + union(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r FROM {_RED_SQL}" for a, b in combinations(REDUNDANT, 2)) + ") WHERE abs(r) >= 0.95")
def leak_perfect_corr(spark, d):
    return r6(leakage.perfect_correlations(_redundant(spark, d), REDUNDANT))


_GAPNET = f"(SELECT CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_extendedprice END AS a, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE {_NET} END AS b, l_quantity AS c FROM lineitem)"


@query("leak_duplicate_features", "SELECT * FROM (" + union(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(abs(corr(coalesce({a}, 0), coalesce({b}, 0))), 6) AS similarity FROM {_GAPNET}" for a, b in combinations("abc", 2)) + ") WHERE similarity >= 0.9")
def leak_duplicate_features(spark, d):
    df = read_table(spark, d, "lineitem").selectExpr("CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_extendedprice END AS a", f"CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE {_NET} END AS b", "l_quantity AS c")
    return r6(leakage.duplicate_numeric(df, ["a", "b", "c"]))


@query("leak_duplicate_categories", "WITH v AS (SELECT DISTINCT 'a' AS f, o_orderpriority AS x FROM orders UNION SELECT DISTINCT 'b', o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT DISTINCT 'c', o_orderstatus FROM orders) SELECT p.f AS feature_1, r.f AS feature_2, round(count(*) / ((SELECT count(*) FROM v WHERE f = p.f) + (SELECT count(*) FROM v WHERE f = r.f) - count(*)), 6) AS similarity FROM v p JOIN v r ON p.x = r.x AND p.f < r.f GROUP BY p.f, r.f HAVING count(*) / ((SELECT count(*) FROM v WHERE f = p.f) + (SELECT count(*) FROM v WHERE f = r.f) - count(*)) >= 0.9")
def leak_duplicate_categories(spark, d):
    df = read_table(spark, d, "orders").selectExpr("o_orderpriority AS a", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS b", "o_orderstatus AS c")
    return r6(leakage.duplicate_categories(df, ["a", "b", "c"]))


_PRED = "(SELECT o_orderstatus AS t, o_orderstatus || '!' AS copy, o_orderpriority AS pri, o_orderkey::VARCHAR AS uid FROM orders)"


@query("leak_perfect_predictor", "WITH " + ", ".join(f"{c} AS (SELECT {c} AS v, count(*) AS n, count(DISTINCT t) AS k FROM {_PRED} GROUP BY 1)" for c in ("copy", "pri", "uid")) + " " + union(f"SELECT '{c}' AS feature, sum(n)::BIGINT AS n, count(*) AS n_values, sum(n) >= 5 AND count(*) FILTER (k = 1) = count(*) AS is_perfect, round(count(*) / sum(n), 6) AS key_likeness, round(count(*) FILTER (k = 1) / count(*), 6) AS pure_share FROM {c}" for c in ("copy", "pri", "uid")))
def leak_perfect_predictor(spark, d):
    df = read_table(spark, d, "orders").selectExpr("o_orderstatus AS t", "o_orderstatus || '!' AS copy", "o_orderpriority AS pri", "cast(o_orderkey as string) AS uid")
    return r6(leakage.perfect_predictors(df, ["copy", "pri", "uid"], "t"))


@query("leak_information", "SELECT feature, round(score, 6) + 0.0 AS score, CASE WHEN score <= 0.8 THEN 'none' WHEN score <= 0.9 THEN 'Medium' ELSE 'High' END AS level FROM (" + union(f"SELECT '{c}' AS feature, abs(corr({c}, net)) AS score FROM {_RED_SQL}" for c in ("l_quantity", "l_extendedprice")) + " UNION ALL SELECT 'l_returnflag', count(*) FILTER (k = 1) / count(*) FROM (SELECT l_returnflag, count(DISTINCT net) AS k FROM " + _RED_SQL + " GROUP BY 1))")
def leak_information(spark, d):
    return r6(leakage.information_scores(_redundant(spark, d), ["l_quantity", "l_extendedprice"], ["l_returnflag"], "net"))


@query("leak_future_dates", "SELECT 'o_orderdate' AS feature, count(o_orderdate) AS n, count(*) FILTER (o_orderdate > TIMESTAMP '2000-01-01') AS n_future, round(count(*) FILTER (o_orderdate > TIMESTAMP '2000-01-01') / count(*) * 100, 6) AS future_pct, year(min(o_orderdate)) < 1900 AS before_1900 FROM orders")
def leak_future_dates(spark, d):
    return r6(leakage.future_dates(read_table(spark, d, "orders"), ["o_orderdate"], "2000-01-01 00:00:00"))


_Q10 = ", ".join(f"quantile_cont(value, {i / 10})" for i in range(1, 10))


@query("leak_mi_binned", f"WITH e AS (SELECT list_distinct([{_Q10}]) AS q FROM events), c AS (SELECT len(list_filter(q, lambda z: z < value)) AS a, event_type AS b, count(*) AS n FROM events, e GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c) SELECT 'value' AS feature, round(sum(c.n / t * ln(c.n * t / (na * nb))), 6) + 0.0 AS mi FROM c JOIN (SELECT a, sum(n) AS na FROM c GROUP BY a) USING (a) JOIN (SELECT b, sum(n) AS nb FROM c GROUP BY b) USING (b), t")
def leak_mi_binned(spark, d):
    return r6(leakage.binned_information(read_table(spark, d, "events"), "value", "event_type"))


# --- fairness --------------------------------------------------------------------------------------------------------

_LAB = "(SELECT * FROM documents JOIN labels USING (doc_id))"


def _labelled(spark, d):
    return read_table(spark, d, "documents").drop("text").join(read_table(spark, d, "labels"), "doc_id")


@query("fair_class_imbalance", f"WITH c AS (SELECT toxic, count(*) AS n FROM {_LAB} GROUP BY 1), a AS (SELECT max(n) AS hi, min(n) AS lo, sum(n)::BIGINT AS n, count(*) AS k FROM c) SELECT n, k AS n_classes, round((hi - lo) / n, 6) AS imbalance, round(hi / lo, 6) AS ratio, CASE WHEN hi / lo < 2 THEN 'none' WHEN hi / lo < 5 THEN 'low' WHEN hi / lo < 10 THEN 'medium' WHEN hi / lo < 50 THEN 'high' ELSE 'critical' END AS severity FROM a")
def fair_class_imbalance(spark, d):
    return r6(fairness.class_imbalance(_labelled(spark, d), "toxic"))


_RATES = f"WITH c AS (SELECT lang AS grp, quality, count(*) AS n FROM {_LAB} GROUP BY 1, 2), r AS (SELECT grp, sum(n)::BIGINT AS n, max(n) / sum(n) AS rate FROM c GROUP BY grp)"


@query("fair_group_rates", f'{_RATES} SELECT grp AS "group", n, round(n / sum(n) OVER (), 6) AS share, round(rate, 6) AS positive_rate FROM r')
def fair_group_rates(spark, d):
    return r6(fairness.group_rates(_labelled(spark, d), "lang", "quality"))


@query("fair_parity", f"{_RATES} SELECT count(*) AS n_groups, round(max(rate) - min(rate), 6) AS max_difference, round(min(rate) / max(rate), 6) AS disparate_impact, max(rate) - min(rate) > 0.1 AS biased FROM r")
def fair_parity(spark, d):
    return r6(fairness.parity(fairness.group_rates(_labelled(spark, d), "lang", "quality")))


_DIST = f"""WITH g AS (SELECT min(lang) AS g1, (SELECT min(lang) FROM {_LAB} WHERE lang > (SELECT min(lang) FROM {_LAB})) AS g2 FROM {_LAB}),
c AS (SELECT quality AS t, count(*) FILTER (lang = g1) AS a, count(*) FILTER (lang = g2) AS b FROM {_LAB}, g WHERE lang IN (g1, g2) GROUP BY 1),
s AS (SELECT CASE WHEN a > 0 THEN a / sum(a) OVER () ELSE 1e-10 END AS p, CASE WHEN b > 0 THEN b / sum(b) OVER () ELSE 1e-10 END AS q FROM c), n AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM s)"""


@query("fair_kl_js", f"{_DIST} SELECT any_value(g1) AS group_1, any_value(g2) AS group_2, round(sum(p * ln(p / q)), 6) AS kl, round(sqrt(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2), 6) AS js FROM n, g")
def fair_kl_js(spark, d):
    return r6(fairness.group_distances(_labelled(spark, d), "lang", "quality"))


@query("fair_proxy", f"WITH k AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM {_LAB})) " + union(f"SELECT '{c}' AS feature, count(*) AS n, round(corr({c}, code), 6) + 0.0 AS r, coalesce(abs(corr({c}, code)) > 0.5, FALSE) AS is_proxy FROM {_LAB} JOIN k USING (lang)" for c in ("n_chars", "quality")))
def fair_proxy(spark, d):
    return r6(fairness.proxies(_labelled(spark, d), ["n_chars", "quality"], "lang"))


@query("fair_intersection", f"WITH c AS (SELECT lang || '_' || source AS g, quality, count(*) AS n FROM {_LAB} GROUP BY 1, 2) SELECT g AS \"group\", sum(n)::BIGINT AS n, round(max(n) / sum(n), 6) AS positive_rate FROM c GROUP BY g HAVING sum(n) >= 10")
def fair_intersection(spark, d):
    return r6(fairness.intersections(_labelled(spark, d), "lang", "source", "quality"))


# --- time series -----------------------------------------------------------------------------------------------------

_BY = "ORDER BY ts, event_id"
ORDER = ["ts", "event_id"]


def _events(spark, d):
    return read_table(spark, d, "events").select("event_id", "ts", "value", "user_id")


@query("ts_coverage", "WITH t AS (SELECT ts, hour(ts) AS h, isodow(ts) - 1 AS w FROM events) SELECT count(*) AS n, floor(epoch(min(ts)))::BIGINT AS first_s, floor(epoch(max(ts)))::BIGINT AS last_s, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)::BIGINT AS span_days, count(DISTINCT ts::DATE) AS unique_dates, round(count(*) / floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000), 6) AS per_day, (SELECT h::INT FROM t GROUP BY h ORDER BY count(*) DESC, h LIMIT 1) AS modal_hour, (SELECT w::INT FROM t GROUP BY w ORDER BY count(*) DESC, w LIMIT 1) AS modal_weekday FROM t")
def ts_coverage(spark, d):
    return r6(timeseries.coverage(_events(spark, d), "ts"))


_STEPS = f"WITH s AS (SELECT epoch_us(ts) AS at_us, epoch_us(ts) - lag(epoch_us(ts)) OVER ({_BY}) AS d FROM events), m AS (SELECT quantile_cont(d::DOUBLE, 0.5) AS m FROM s)"


@query("ts_gaps", f"{_STEPS} SELECT at_us - d AS after_us, d AS gap_us FROM s, m WHERE d > 2 * m")
def ts_gaps(spark, d):
    return timeseries.gaps(_events(spark, d), "ts", ORDER)


@query("ts_gap_summary", f"{_STEPS} SELECT count(d) AS n_steps, count(*) FILTER (d > 2 * m) AS n_gaps, round(count(*) FILTER (d > 2 * m) / count(d) * 100, 6) AS gap_pct, max(d) FILTER (d > 2 * m) AS largest_us, min(d) FILTER (d > 2 * m) AS smallest_us FROM s, m")
def ts_gap_summary(spark, d):
    return r6(timeseries.gap_summary(_events(spark, d), "ts", ORDER))


def _acf_sql(lags) -> str:
    leads = ", ".join(f"lead(value, {k}) OVER ({_BY}) - m AS x{k}" for k in lags)
    return f"WITH c AS (SELECT value - m AS x, {leads} FROM events, (SELECT avg(value) AS m FROM events)), a AS (" + union(f"SELECT {k} AS lag, count(*) AS n, sum(x * x{k}) / sum(x * x) AS acf FROM c" for k in lags) + ")"


_L20 = range(1, 21)


@query("ts_acf", f"{_acf_sql(_L20)} SELECT lag, n, round(acf, 6) + 0.0 AS acf, abs(acf) > 1.96 / sqrt(n) AS significant FROM a")
def ts_acf(spark, d):
    return r6(timeseries.autocorrelation(_events(spark, d), "value", ORDER, list(_L20)))


@query("ts_ljung_box", f"{_acf_sql(range(1, 11))} SELECT round(max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)), 5) AS q, count(*) AS dof FROM a")
def ts_ljung_box(spark, d):
    return r6(timeseries.ljung_box(timeseries.autocorrelation(_events(spark, d), "value", ORDER, list(range(1, 11)))), 5)


@query("ts_seasonality", f"{_acf_sql((4, 7, 12, 24))} SELECT lag AS period, round(acf, 6) + 0.0 AS acf, abs(acf) > 0.3 AS seasonal FROM a")
def ts_seasonality(spark, d):
    return r6(timeseries.seasonality(_events(spark, d), "value", ORDER))


@query("ts_trend", f"WITH t AS (SELECT value AS y, (row_number() OVER ({_BY}) - 1)::DOUBLE AS x FROM events) SELECT count(*) AS n, round(regr_slope(y, x), 9) + 0.0 AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(y, x), 6) + 0.0 AS r, CASE WHEN abs(corr(y, x)) < 0.1 THEN 'none' WHEN regr_slope(y, x) > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM t")
def ts_trend(spark, d):
    return r6(timeseries.trend(_events(spark, d), "value", ORDER), slope=9)


@query("ts_dickey_fuller", f"WITH p AS (SELECT lag(value) OVER ({_BY}) AS x, value - lag(value) OVER ({_BY}) AS y FROM events), g AS (SELECT count(x) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM p) SELECT n, round(b, 6) AS coefficient, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 5) AS t_stat, b / sqrt((syy - b * sxy) / (n - 2) / sxx) < -2.86 AS stationary FROM g")
def ts_dickey_fuller(spark, d):
    return r6(timeseries.dickey_fuller(_events(spark, d), "value", ORDER), t_stat=5)


@query("ts_look_ahead", f"WITH t AS (SELECT value, user_id, lead(value) OVER ({_BY}) AS nx FROM events), e AS (SELECT *, nx * 2 + 1 AS leak FROM t) " + union(f"SELECT '{c}' AS feature, round(corr({c}, value), 6) + 0.0 AS r_now, round(corr({c}, nx), 6) + 0.0 AS r_next, abs(corr({c}, nx)) > 0.8 AS look_ahead, abs(corr({c}, value)) > 0.95 AS too_close FROM e" for c in ("user_id", "leak")))
def ts_look_ahead(spark, d):
    df = timeseries.shifted_targets(_events(spark, d), "value", ORDER, [1]).selectExpr("event_id", "ts", "value", "user_id", "lead_1 * 2 + 1 AS leak")
    return r6(timeseries.look_ahead(df, ["user_id", "leak"], "value", ORDER))


@query("ts_features_lag", f"SELECT event_id, round(lag(value, 1) OVER w, 6) AS lag_1, round(lag(value, 2) OVER w, 6) AS lag_2, round(lag(value, 3) OVER w, 6) AS lag_3, round(value - lag(value) OVER w, 6) + 0.0 AS diff_1, round(value / nullif(lag(value) OVER w, 0) - 1, 4) + 0.0 AS pct_change FROM events WINDOW w AS ({_BY})")
def ts_features_lag(spark, d):
    return r6(timeseries.lag_features(_events(spark, d), "value", ORDER, [1, 2, 3]).select("event_id", "lag_1", "lag_2", "lag_3", "diff_1", "pct_change"), pct_change=4)


_ROLL = [f"{f}_{k}" for k in (3, 7) for f in ("mean", "std", "min", "max")]


@query("ts_features_rolling", "SELECT event_id, " + ", ".join(f"round({g}(value) OVER (ORDER BY ts, event_id ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 5) AS {f}_{k}" for k in (3, 7) for f, g in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM events")
def ts_features_rolling(spark, d):
    return r6(timeseries.rolling_features(_events(spark, d), "value", ORDER, [3, 7]).select("event_id", *_ROLL), 5)


@query("ts_ewm", "WITH n AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS i FROM events) SELECT a.event_id, round(sum(b.value * power(0.75, a.i - b.i)) / sum(power(0.75, a.i - b.i)), 5) AS ewm FROM n a JOIN n b ON b.i BETWEEN a.i - 127 AND a.i GROUP BY a.event_id")
def ts_ewm(spark, d):
    return r6(timeseries.ewm_mean(_events(spark, d), "value", ORDER).select("event_id", "ewm"), 5)


@query("stability_segments", "WITH n AS (SELECT value, user_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS c FROM events), g AS (SELECT *, least(least(5, c // 100) - 1, i // (c // least(5, c // 100))) AS seg FROM n) " + union(f"SELECT '{c}' AS feature, count(*) AS n_segments, round(1 / (1 + stddev_pop(m) / abs(avg(m)) + stddev_pop(s) / abs(avg(s))), 6) AS stability, 1 / (1 + stddev_pop(m) / abs(avg(m)) + stddev_pop(s) / abs(avg(s))) < 0.7 AS unstable FROM (SELECT seg, avg({c}) AS m, stddev_pop({c}) AS s FROM g GROUP BY seg)" for c in ("value", "user_id")))
def stability_segments(spark, d):
    return r6(timeseries.segment_stability(_events(spark, d), ["value", "user_id"], ORDER))


@query("percentile_rank", "WITH c AS (SELECT n_chars::DOUBLE AS value, count(*) AS n FROM documents GROUP BY 1) SELECT value, n, round((sum(n) OVER (ORDER BY value) - n) / sum(n) OVER () * 100, 6) AS below_pct FROM c")
def percentile_rank(spark, d):
    return r6(timeseries.percentile_rank(read_table(spark, d, "documents"), "n_chars"))
