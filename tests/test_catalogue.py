"""Every query with a SQL twin gives its rows."""

import os

import duckdb
import pytest

import __spark_entry__
from loomquill.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*names).collect())
    if sql := catalogue.oracle_sql().get(name):
        c = duckdb.connect()
        for f in os.listdir(DATA):
            c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
        r = c.execute(sql)
        cols = [x[0] for x in r.description]
        assert sorted(cols) == names
        assert got == sorted(tuple(str(row[cols.index(n)]) for n in names) for row in r.fetchall())
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
