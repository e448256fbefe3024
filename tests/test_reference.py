import math
import os

import duckdb
import pytest

from gridloom.plans import registry


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    return c


def text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    try:
        return repr(float(v) + 0.0)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(registry.core_sql()))
def test_same_as_sql(spark, small, duck, name):
    df = registry.core_queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(registry.core_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in rel.fetchall())
    assert got or name == "find_nc"
