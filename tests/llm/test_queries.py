import math
import os

import duckdb
import pytest

from gridloom.llm.queries import QUERIES, SQL


def text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(float(v) + 0.0) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, name):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rel = c.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(x) for x in columns]
    got = sorted(tuple(text(r[x]) for x in columns) for r in df.collect())
    assert got and got == sorted(tuple(text(r[i]) for i in at) for r in rel.fetchall())
