"""Every query that has SQL against DuckDB on the smallest tables; the others must run and keep their columns."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables are not here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    return (1, round(float(v), 4)) if isinstance(v, int | float) and not isinstance(v, bool) else (2, str(v))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, TABLES)
    columns = sorted(got.columns)
    rows = sorted(tuple(_plain(r[c]) for c in columns) for r in got.collect())
    if name not in SQL:
        return
    want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({SQL[name]})").fetchall()
    want = sorted(tuple(_plain(v) for v in r) for r in want)
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (x[0] == y[0] == 1 and math.isclose(x[1], y[1], rel_tol=1e-4, abs_tol=2e-4)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
