"""Queries on all orders."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = [(k, k % 90 + 60, "FOP"[k % 3], float(k), dt.datetime(1998 + k % 4, 3, 1)) for k in range(1, 180)]
    path = tmp_path_factory.mktemp("orders")
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(f"{path}/orders.parquet")
    return str(path), rows


def test_latest_earlier_year(spark, table):
    got = entry.queries()["latest_earlier_year"](spark, table[0]).collect()
    assert sorted(tuple(r) for r in got) == [(r[0], 2000) for r in table[1] if r[4].year == 2000]


def test_wide_round_trip(spark, table):
    want = Counter()
    for r in table[1]:
        want[str(r[1]), r[2], str(r[4].year)] += r[3]
    got = entry.queries()["wide_round_trip"](spark, table[0]).collect()
    assert {(r.kod, r.status, r.year): r.value for r in got} == want
