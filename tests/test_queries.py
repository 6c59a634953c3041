"""Every registered query of the library proper against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from skylark.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "~" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted("|".join(show(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
