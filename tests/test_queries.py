"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tessera import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    return str(v) if isinstance(v, (datetime.datetime, datetime.date)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = duck.execute(catalog.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql_or_a_reason():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"assignment", "receipt_sample"}
