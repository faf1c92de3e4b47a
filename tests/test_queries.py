"""Every registered query runs; where there is SQL, both give the same rows."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

from threadloom.queries import ORACLE_SQL, QUERIES


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: str(x.date() if isinstance(x, datetime.datetime) else x)
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = rows_of(df.columns, df.collect())
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        assert got == rows_of([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", ["cohort_groups", "strict_order", "order_summary", "displacement_bands", "reference_counts", "assignment_counts", "sliding_unions", "shortfall_bands", "guard_counts"])
def test_queries_are_not_empty(spark, small, name):
    assert not QUERIES[name](spark, small).isEmpty()
