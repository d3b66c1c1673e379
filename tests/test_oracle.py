"""Every registered query against the SQL written for it, on the smallest tables."""

import math

import duckdb
import pytest

from quarterlight.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 8) + 0.0
    return value


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = sql.execute(oracle.SQL[name])
    expected_columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(expected_columns)
    order = sorted(df.columns)
    got = [tuple(canonical(r[c]) for c in order) for r in df.collect()]
    at = [expected_columns.index(c) for c in order]
    expected = [tuple(canonical(r[i]) for i in at) for r in cursor.fetchall()]
    assert expected
    assert sorted(got, key=repr) == sorted(expected, key=repr)
