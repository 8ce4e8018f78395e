"""Every query with SQL gives DuckDB's rows on the same tables; the others give rows with a stable schema."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from kgloom import catalog
from kgloom.registry import ORACLES, QUERIES

catalog.load()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    expected = [tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()]
    assert ordered(got) == ordered(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows and len(rows[0]) == len(df.columns)
