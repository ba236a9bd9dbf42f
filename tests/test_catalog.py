"""Every registered query of the core against its SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from strataloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    got = catalog.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if sql := catalog.oracle_sql().get(name):
        want = db.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert table(got.columns, rows) == table(want.columns, want.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert catalog.entry(spark, SF).count() > 0
