"""Every registered query of the library against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from molecast.queries import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_equals_sql(spark, db, name):
    f, sql = REGISTRY[name]
    df = f(spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=repr)
    if sql is None:
        assert got
        return
    want = db.sql(sql)
    assert sorted(want.columns) == cols
    place = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in place) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
