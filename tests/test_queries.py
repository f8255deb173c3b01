"""Every registered query with SQL gives the rows of the SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lectern.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.item() if hasattr(v, "item") else v


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(made, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    found = duck.sql(ORACLES[name])
    assert table_of(df.columns, df.collect()) == table_of(found.columns, found.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 8
    assert set(e.oracle_sql()) <= set(e.queries())
