"""Every registered query of the graph engine against DuckDB, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from weftgraph import catalog


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, con, name):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert df.columns
        return
    cur = con.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert rows == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
