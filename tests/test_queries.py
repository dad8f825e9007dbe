"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from tests.conftest import SF_DIR

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF_DIR}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def test_every_query_has_its_sql():
    assert set(ORACLE) <= set(QUERIES)
    assert {name for module in contract._MODULES[:7] for name in module.QUERIES} <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = db.execute(ORACLE[name])
    expected = table([d[0] for d in cursor.description], cursor.fetchall())
    assert table(df.columns, df.collect()) == expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0
