"""Every query with SQL gives the rows that DuckDB gives for it."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from lakequill.plans.catalog import QUERIES, SQL

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, (list, np.ndarray)):
        return [value(y) for y in x]
    if x is None or pd.isna(x):
        return None
    x = x.item() if hasattr(x, "item") else x
    return (int(x) if x == int(x) else round(x, 9)) if isinstance(x, float) else x


def rows(df):
    return sorted(repr([value(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, DIR).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_give_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(QUERIES) > 60
