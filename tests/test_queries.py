"""Every registered query with SQL is held against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tracklight.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def rows(table, columns):
    return sorted((tuple(plain(r[i]) for i in columns) for r in table), key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    cur = db.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = rows(cur.fetchall(), [names.index(c) for c in order])
    have = rows([tuple(r) for r in got.collect()], [got.columns.index(c) for c in order])
    assert len(want) == len(have)
    for a, b in zip(have, want, strict=True):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 1e-5 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)


def test_queries_without_sql_give_rows(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLES)):
        assert registry.QUERIES[name](spark, SF).count() > 0
