"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def database(small):
    con = duckdb.connect()
    for t in os.listdir(small):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{small}/{t}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return repr(list(v)) if isinstance(v, (list, tuple)) else repr(v) if isinstance(v, float) else str(v)


def rows_of(rows):
    return sorted([tuple(map(plain, r)) for r in rows], key=lambda r: tuple(x or "" for x in r))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, database, name):
    got = entry.queries()[name](spark, small)
    got = got.select(sorted(got.columns))
    rows = rows_of(got.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = database.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert got.columns == sorted(names)
    assert rows == rows_of([tuple(r[i] for i in order) for r in found.fetchall()])


def test_entry(spark, small):
    assert entry.entry(spark).schema.names
