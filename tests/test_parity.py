"""Every registered query against its DuckDB statement on the smallest given data."""

import decimal
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from checks.fixtures import BASE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == sorted(df.columns)
    pick = [at.index(c) for c in df.columns]
    want = sorted(repr(tuple(plain(r[i]) for i in pick)) for r in cur.fetchall())
    assert sorted(repr(tuple(plain(v) for v in r)) for r in df.collect()) == want


#: Queries without a statement that have rows on any given data; training-data operators have tests of their own.
FILLED = {"line_list", "geom_diff", "geom_runs", "geom_features", "geom_lengths"}
PLAIN = sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if n != "pipeline" and not re.match(r"op\d+_", n))


@pytest.mark.parametrize("name", PLAIN)
def test_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns) > 0
    assert rows or name not in FILLED
