"""The mix against enumeration: least cost, many sources, many patterns, equal rows, ties."""

from __future__ import annotations

import itertools
import random
import time
from collections import Counter, defaultdict

import pytest

from terrano.llm import mixing


def cheapest(capacity, quota, most):
    """(largest flow, least cost of such a flow) by trying all integer flows."""
    arcs = [(p, q) for p in capacity for q in p]
    best = (0, 0)
    for flow in itertools.product(*[range(min(most * capacity[p], quota[q]) + 1) for p, q in arcs]):
        used, got = Counter(), Counter()
        for (p, q), n in zip(arcs, flow, strict=True):
            used[p] += n
            got[q] += n
        if any(used[p] > most * capacity[p] for p in capacity) or any(got[q] > quota[q] for q in quota):
            continue
        best = max(best, (sum(flow), -cost(used, capacity, most)))
    return best[0], -best[1]


def cost(used, capacity, most):
    """Each repetition r of a token costs r * r + r."""
    total = 0
    for p, n in used.items():
        for r in range(most):
            take = min(n, capacity[p])
            total += take * (r * r + r)
            n -= take
    return total


def test_least_cost():
    r = random.Random(6)
    for _ in range(60):
        patterns = r.sample([("a",), ("b",), ("c",), ("a", "b"), ("b", "c")], r.randint(1, 3))
        capacity = {p: r.randint(0, 3) for p in patterns}
        quota = {q: r.randint(0, 5) for q in {q for p in patterns for q in p}}
        flow = mixing.min_cost_flow(capacity, quota, 2)
        used, got = Counter(), Counter()
        for (p, q), n in flow.items():
            assert n >= 0
            used[p] += n
            got[q] += n
        assert all(got[q] <= quota[q] for q in quota)
        assert (sum(flow.values()), cost(used, capacity, 2)) == cheapest(capacity, quota, 2)


def test_many_patterns():
    r = random.Random(1)
    names = [f"s{i}" for i in range(300)]
    capacity = {tuple(sorted(r.sample(names, r.randint(1, 3)))): r.randint(1, 10_000) for _ in range(100_000)}
    sizes = Counter()
    for p, n in capacity.items():
        for q in p:
            sizes[q] += n
    began = time.time()
    flow = mixing.min_cost_flow(capacity, {q: int(v) for q, v in mixing.source_targets(dict(sizes)).items()})
    assert time.time() - began < 120 and sum(flow.values()) > 0


def docs(spark, n=400, sources=40):
    r = random.Random(2)
    names = [f"s{i:02d}" for i in range(sources)] + [None, "é"]
    rows = [(i, "w " * r.randint(0, 30), r.choice(names)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_table_of_targets(spark, monkeypatch):
    df = docs(spark)
    few = sorted(map(str, mixing.mixed(df).drop("key", "target").collect()))
    targets = {r.source: r.target for r in mixing.mixed(df).collect()}
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 5)
    many = mixing.mixed(df)
    assert sorted(map(str, many.drop("key", "target").collect())) == few
    assert all(abs(r.target - targets[r.source]) < 1e-6 for r in many.collect())
    over = df.selectExpr("doc_id", "text", "array(source, 'x') AS source")
    with pytest.raises(ValueError):
        mixing.mixed(over)


def test_equal_rows(spark):
    """Two thirds of the rows are one and the same: they are taken like any others."""
    rows = [(i, "a b c d", "s") for i in range(100)] + [(7, "x y z", "s")] * 200 + [(None, "n n", None)] * 50 + [(1, "same text", "p"), (1, "same text", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(df.repartition(3)).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    by, target = defaultdict(int), {}
    for r in got:
        by[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(by[s] - target[s]) <= 4 for s in by)
    again = mixing.mixed(df.repartition(7)).collect()
    assert sorted(str((r.doc_id, r.source, r.size, r.taken)) for r in got) == sorted(str((r.doc_id, r.source, r.size, r.taken)) for r in again)
    out = Counter(tuple(r) for r in mixing.resampled(df).collect())
    want = Counter()
    for r in got:
        want[r.doc_id, r.source, r.size] += r.copies
    assert {(i, s, len(t.split())): n for (i, t, s), n in out.items()} == {k: n for k, n in want.items() if n}
