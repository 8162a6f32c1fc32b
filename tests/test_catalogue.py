"""Every registered log query against its DuckDB twin."""

import duckdb
import pytest

from logloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_equals_sql(spark, sf, db, name):
    got = catalogue.QUERIES[name](spark, sf)
    found = db.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, found.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
