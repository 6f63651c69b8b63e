"""The registered queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkprep.queries import tabular

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(rows, columns):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "NULL"
        return f"{float(v):.7g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(tabular.QUERIES))
def test_query(spark, db, name):
    df = tabular.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in tabular.ORACLES:
        assert rows
        return
    got = db.execute(tabular.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(got.fetchall(), columns)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
