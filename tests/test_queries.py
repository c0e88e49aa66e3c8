"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from assaykit import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def tidy(df):
    out = {}
    for c in sorted(df.columns):
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            out[c] = df[c].astype(float).round(4)
        else:
            out[c] = df[c].map(lambda x: None if x is None or x is pd.NA or x != x else str(x))
    return pd.DataFrame(out).sort_values(sorted(out), na_position="last").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = tidy(engine.QUERIES[name](spark, DATA).toPandas()), tidy(duck.sql(engine.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-4, atol=2e-4)


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLE_SQL)))
def test_runs(spark, name):
    assert engine.QUERIES[name](spark, DATA).count() > 0


def test_entry_imports_without_a_session_and_has_sql_for_known_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(engine.QUERIES) <= set(e.queries())
