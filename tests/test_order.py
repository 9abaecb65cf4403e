"""Queries whose result is an order: rows come in it, and it is the one that SQL gives."""

import os

import duckdb
import pytest

from corpusloom.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations", "events", "lineitem"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["a02_marker_frequency", "t01_curriculum_order", "t02_curriculum_by_message", "t03_top_k", "t04_order_by_lift", "t06_limit", "t07_seeded_shuffle", "t08_group_order"])
def test_rows_come_in_order(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
    assert [tuple(r) for r in got.collect()] == want
