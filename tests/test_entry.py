import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
OWN = [n for n in entry.queries() if not re.match(r"op\d+_", n) and n != "pipeline"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    return con


def plain(df, columns):
    out = df[columns].astype(object).where(df[columns].notna(), None).astype(str)
    return out.replace({r"^(-?\d+)\.0$": r"\1", r"^-0$": "0"}, regex=True).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, oracle, name):
    got = entry.queries()[name](spark, D).toPandas()
    sql = entry.oracle_sql().get(name)
    assert sql, "every query on the engine's own tables has an oracle"
    want = oracle.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns).equals(plain(want, columns))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
