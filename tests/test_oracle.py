"""Every query with SQL against DuckDB on the smallest tables: names, types, rows."""

import glob
import math
import os

import duckdb
import pytest

from corpusloom import plans

DATA = "/root/testdata/sf0.001"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rounded(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name not in plans.ORACLE:
        assert got
        return
    want = con.sql(plans.ORACLE[name])
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    rows = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({plans.ORACLE[name]})").fetchall()
    assert rounded(got) == rounded(rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
