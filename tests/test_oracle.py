"""Every registered query against its DuckDB statement on the driver tables (sf0.001)."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as E
from caseload.plans import catalog
from tools.compare import TABLES, digest, type_mismatches

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_registered_with_oracle_or_listed():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and set(catalog.QUERIES) <= set(qs)
    qs, sql = set(qs) & set(catalog.QUERIES), set(sql) & set(catalog.QUERIES)
    assert set(qs) - set(sql) == E.NO_ORACLE


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert type_mismatches(df, cur) == []
    assert len(rows) == len(drows)
    assert digest(df.columns, rows) == digest(dcols, drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 10
    assert "priority_score" in df.columns
