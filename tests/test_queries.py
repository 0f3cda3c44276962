"""Every registered query with SQL against that SQL, on the smallest tables; all others must run."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def cell(x):
    if x is None or x != x:
        return "NULL"
    if isinstance(x, float):
        return str(int(x)) if math.isfinite(x) and x == int(x) else f"{x:.6f}"
    return str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    import duckdb

    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*columns).collect())
    if name not in SQL:
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(cell(r[i]) for i in order) for r in cursor.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
