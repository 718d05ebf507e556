"""Every registered query runs; those with SQL agree with it row by row on the smallest tables."""

import math

import duckdb
import pytest

from quirespark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations benchmark labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    assert rows
    sql = registry.oracle_sql().get(name)
    if sql:
        rel = duck.sql(sql)
        at = [rel.columns.index(c) for c in names]
        assert sorted(rel.columns) == names
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry_points():
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and "region_assign" in q
