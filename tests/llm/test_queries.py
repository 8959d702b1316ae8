"""Registered queries against their DuckDB twins at the scale of the correctness gate."""

import os

import duckdb
import pytest

from reportloom.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    show = lambda names, rows: sorted(str([f"{r[k]:.6g}" if isinstance(r[k], float) else r[k] for k in map(names.index, sorted(names))]) for r in rows)
    assert show(got.columns, got.collect()) == show(want.columns, want.fetchall())
