"""Every registered query runs at the smallest scale and, where it has one, equals its oracle SQL."""

import math
import os

import pytest

from logloom.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    try:
        return f"{float(x):.6g}"
    except (TypeError, ValueError):
        return str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def check(spark, duck, queries, oracles, name):
    df = queries[name](spark, DATA)
    got = table(df.columns, df.collect())
    if name in oracles:
        want = duck.execute(oracles[name])
        assert got == table([c[0] for c in want.description], want.fetchall())
    else:
        assert got[1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    check(spark, duck, catalogue.QUERIES, catalogue.ORACLES, name)


def test_entry_has_every_query():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
