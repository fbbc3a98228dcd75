"""Every query of the core with SQL gives the same rows as that SQL on another engine."""

import glob
import math
import os

import duckdb
import pytest

from tidewright.plans import registry

SQL = registry.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(root):
    c = duckdb.connect()
    for p in glob.glob(f"{root}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, root, duck, name):
    df = registry.queries()[name](spark, root)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    res = duck.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=str)
    assert list(map(str, got)) == list(map(str, want))


def test_every_query_is_listed():
    assert set(SQL) <= set(registry.queries())
