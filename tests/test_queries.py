"""Every registered query of the index against its DuckDB statement, on the smallest tables."""

import math

import duckdb
import pytest

from tessera.queries import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{ROOT}/{t}.parquet')")
    return c


def rows(df, columns):
    return sorted(repr([None if isinstance(x, float) and math.isnan(x) else x for x in r]) for r in df[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, ROOT).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
