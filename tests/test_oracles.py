"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    rel = duck.execute(registry.oracles()[name])
    names = [c[0] for c in rel.description]
    want = rows(names, rel.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
