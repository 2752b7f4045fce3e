"""Every query beside its SQL at the smallest size."""

import os

import duckdb
import pytest

from lexisift.plans.catalog import catalog

DATA = "/root/testdata/sf0.001"
WITH_SQL = sorted(n for n, (_, sql) in catalog().items() if sql)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: str(round(v, 5) + 0) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, db, name):
    f, sql = catalog()[name]
    df = f(spark, DATA)
    want = db.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
