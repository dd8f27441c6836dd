"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(found, columns):
    plain = lambda v: v if v is None or isinstance(v, (bool, float, int)) else str(v)
    return sorted((tuple(plain(r[c]) for c in columns) for r in found), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    got = entry.queries()[name](spark, DATA)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    columns = sorted(got.columns)
    want = rows([dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()], columns)
    have = rows([r.asDict() for r in got.collect()], columns)
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert all(x == y or (isinstance(x, float) and y == pytest.approx(x, abs=2e-6, rel=1e-6)) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
