"""Every registered span query gives the rows of its SQL on the smallest tables."""

import glob
import math
import os

import pytest

from spanlake.plans import registry

SMALL = "/root/testdata/sf0.001"


def plain(v):
    """A value as text, with floats at six digits, so that rows of two engines compare and sort alike."""
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if hasattr(v, "as_integer_ratio"):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SMALL)
    wanted = duck.execute(registry.SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(tuple(plain(v) for v in row) for row in wanted.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in got.collect()) == rows
