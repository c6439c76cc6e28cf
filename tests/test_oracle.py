"""Every registered query with an oracle: Spark result == DuckDB result (the driver's gate).

Runs at sf0.001 by default (SMOGCAST_TEST_SF overrides); each query reads whole tables.
"""

import os

import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, rows_of

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(SQL[name]).df()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_every_query_has_a_callable(spark):
    qs = entry.queries()
    assert set(SQL) <= set(qs)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0
