"""The graph queries on all users, against plain loops."""

from __future__ import annotations

import datetime as dt
import heapq
import random
from functools import partial

import numpy as np
import pytest

import __spark_entry__ as entry
from terrano.operators import graph


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(8)
    day = dt.datetime(2024, 1, 1)
    # ids on both sides of the old bounds; the later users never lead back, and the chain is longer than three edges
    users = [[1, 100, 2, 200, 61, 3, 70, 1], [150, 151, 150], [3, 150], *[[r.choice([1, 2, 3, 61, 70, 100, 200]) for _ in range(9)] for _ in range(2)]]
    rows, k = [], 0
    for d, us in enumerate(users):
        for j, u in enumerate(us):
            rows.append((k, day + dt.timedelta(days=d, minutes=j), u, "x", round(r.uniform(0, 9), 2), "{}"))
            k += 1
    path = tmp_path_factory.mktemp("graph")
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    edges = {}
    for (_, t, u, _, x, _), (_, t2, v, *_) in zip(rows, rows[1:], strict=False):
        if t.date() == t2.date() and u != v:
            edges[u, v] = min(edges.get((u, v), 1e9), x + 1)
    nodes = sorted({x for e in edges for x in e})
    far = {(a, a): 0.0 for a in nodes} | {(a, b): edges[a, b] for a, b in edges}
    for m in nodes:
        for a in nodes:
            for b in nodes:
                if (a, m) in far and (m, b) in far:
                    far[a, b] = min(far.get((a, b), 1e9), far[a, m] + far[m, b])
    return str(path), edges, nodes, far


def test_edges(spark, table):
    got = {(r.u, r.v): r.time for r in entry.queries()["fastest_edges"](spark, table[0]).collect()}
    assert got == pytest.approx(table[1], abs=1e-4)


@pytest.mark.parametrize("name", ["travel_times", "relaxed_times"])
def test_times(spark, table, name):
    got = {(r.o, r.d): r.sec for r in entry.queries()[name](spark, table[0]).collect()}
    assert got == pytest.approx(table[3], abs=1e-3)


def test_components(spark, table):
    _, _, nodes, far = table
    got = {r.node: r.scc for r in entry.queries()["strong_components"](spark, table[0]).collect()}
    assert got == {a: min(b for b in nodes if (a, b) in far and (b, a) in far) for a in nodes}


def test_rounds_leave_only_the_result(spark, table, monkeypatch):
    written, cut = [], graph.cut

    def spied(df):
        written.append(cut(df))
        return written[-1]

    monkeypatch.setattr(graph, "cut", spied)
    monkeypatch.setattr(graph, "MAX_PAIRS", 30, raising=False)  # several blocks of sources
    got = {(r.o, r.d): r.sec for r in entry.queries()["relaxed_times"](spark, table[0]).collect()}
    assert got == pytest.approx(table[3], abs=1e-3)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    kept = [x for x in written if path(x._cut_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(x._cut_path))]
    assert len(kept) <= -(-len(table[2]) ** 2 // 30)


def test_edges_pass_the_driver_packed(spark, table, monkeypatch):
    def no(self):
        raise AssertionError("rows of the graph came to the driver")

    monkeypatch.setattr(type(spark.range(1)), "toPandas", no)
    e = spark.createDataFrame([(str(u), str(v), t, 1.0) for (u, v), t in table[1].items()], "u string, v string, time double, len double")
    n = spark.createDataFrame([(str(x),) for x in [*table[2], -1]], "node string")
    got = {(int(r.o), int(r.d)): r.sec for r in graph.travel_times(e, n, n).collect()}
    assert got == pytest.approx(table[3], abs=1e-6)


def _plain(edges, s):
    """Dijkstra by a heap."""
    far, heap = {}, [(0.0, s)]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in far:
            far[x] = d
            for (u, v), t in edges.items():
                if u == x:
                    heapq.heappush(heap, (d + t, v))
    return far


def _rows(spark, edges):
    nodes = sorted({x for e in edges for x in e})
    e = spark.createDataFrame([(u, v, t, 1.0) for (u, v), t in edges.items()], "u long, v long, time double, len double")
    return e, spark.createDataFrame([(x,) for x in nodes], "node long"), {(a, b): d for a in nodes for b, d in _plain(edges, a).items()}


def test_rounds_write_nothing(spark, monkeypatch):
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(1) or cut(df))
    edges = {(i, i + 1): 0.5 for i in range(12)} | {(0, 12): 9.0, (12, 3): 1.0}
    e, n, far = _rows(spark, edges)
    assert {(r.o, r.d): r.sec for r in graph.relaxed(e, n).collect()} == far
    assert len(written) < 12  # a write a round before
    alone = spark.createDataFrame([(0,), (0,), (77,)], "node long")
    assert sorted((r.o, r.d, r.sec) for r in graph.relaxed(e, alone, 2).collect()) == [(0, 0, 0.0), (0, 1, 0.5), (0, 2, 1.0), (0, 3, 10.0), (0, 12, 9.0), (77, 77, 0.0)]


def test_many_sources_take_few_steps(monkeypatch):
    r = random.Random(3)
    n = 150
    # a grid of equal times (many ties), random edges, and nodes without a way out
    edges = {(i, j): 1.0 for i in range(100) for j in ([i + 1] if i % 10 < 9 else []) + ([i + 10] if i < 90 else [])}
    edges |= {(r.randrange(n - 10), r.randrange(n)): r.randint(100, 9000) / 100 for _ in range(900)}
    edges = dict(sorted((e, t) for e, t in edges.items() if e[0] != e[1]))
    u, v = np.array(list(edges), np.int32).T
    links = (np.searchsorted(u, np.arange(n + 1)), v, np.array(list(edges.values())))
    far = [_plain(edges, s) for s in range(n)]
    steps, moved = [], graph._moved
    monkeypatch.setattr(graph, "_moved", lambda *a: steps.append(1) or moved(*a))
    monkeypatch.setattr(graph, "MAX_STEPS", 1000)
    for settle in (graph._in_order, partial(graph._in_rounds, None)):
        steps.clear()
        dist, mark, pairs = np.full(n * n, np.inf), np.empty(n * n, np.int32), np.arange(n) * (n + 1)
        dist[pairs] = 0
        settle(dist, mark, pairs, links)
        assert {divmod(int(x), n): dist[x] for x in np.flatnonzero(np.isfinite(dist))} == pytest.approx({(s, d): t for s in range(n) for d, t in far[s].items()})
        assert len(steps) < n  # by a heap each source alone takes up to n


@pytest.mark.parametrize("most", [0, 10_000_000])
def test_times_by_joins_and_by_workers(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "MAX_EDGES", most)
    monkeypatch.setattr(graph, "BLOCK", 15, raising=False)  # several blocks a task
    monkeypatch.setattr(graph, "MAX_ROWS", 2, raising=False)
    edges = {(1, 2): 4.0, (2, 3): 1.0, (3, 1): 2.5, (1, 3): 9.0, (4, 1): 1.0, (5, 6): 3.0}
    e, n, far = _rows(spark, edges)
    e = e.union(spark.createDataFrame([(2, 5, None, 1.0), (6, 1, float("nan"), 1.0)], e.schema))  # without a time, no way
    assert {(r.o, r.d): r.sec for r in graph.travel_times(e, n, n.where("node != 3")).collect()} == {(o, d): t for (o, d), t in far.items() if d != 3}
    assert {(r.o, r.d): r.sec for r in graph.relaxed(e, n).collect()} == far
