"""The engine's own operators on small hand-made tables."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrano.functions import codes, parse
from terrano.operators import graph, hedonic, model, od, relational, spatial, stats
from terrano.sources import tables
from terrano.streaming import windows


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_codes(spark):
    x = ["0201011", "201011", "02 01 011", "12345678", "", None]
    assert column(spark, x, codes.code7) == ["0201011", "0201011", "0201011", "12345678", "0000000", None]
    assert column(spark, x, codes.code6) == ["020101", "020101", "020101", "123456", "000000", None]
    assert column(spark, ["0201000", "0200000", "0201011"], codes.is_county) == [True, False, False]


def test_numbers_and_speeds(spark):
    assert column(spark, ["1 234,5", "", "0", "abc", None], parse.to_number) == [1234.5, None, 0.0, None, None]
    assert column(spark, ["0,00", "3,5"], parse.reported) == [None, 3.5]
    got = column(spark, ["50", "50 mph", "50;70", "PL:urban", "signals", "walk", "999", None], parse.max_speed)
    assert got[0] == 50 and abs(got[1] - 80.4672) < 1e-9 and got[2:] == [50, 50, None, 5, None, None]


def test_crosswalk(spark):
    flows = spark.createDataFrame([("a", "b", 100.0), ("c", "a", 10.0)], "res string, work string, count double")
    walk = spark.createDataFrame([("a", "a", 1.0), ("b", "x", 0.72), ("b", "y", 0.28), ("c", "a", 1.0)], "src string, dst string, weight double")
    got = {(r.res, r.work): r["count"] for r in relational.recoded_flows(flows, walk).collect()}
    assert got == pytest.approx({("a", "x"): 72.0, ("a", "y"): 28.0, ("a", "a"): 10.0})
    with pytest.raises(ValueError):
        relational.recoded_flows(flows, walk.where("src != 'c'"))


def test_interpolation(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])] + [("b", 0, None)], "k string, p int, v double")
    assert [r.v for r in relational.interpolated(df, "k", "p", "v").orderBy("p").collect()] == [1, 1, 2, 3, 3]


def test_robust_trim(spark):
    rows = [("a", "x", float(100 + i % 5)) for i in range(31)] + [("a", "x", 10_000.0)] + [("b", "x", 5.0)] * 3
    df = spark.createDataFrame(rows, "p string, k string, v double")
    assert stats.robust_trim(df, "v", ["p", "k"], ["p"], 30).count() == 34


def test_imputation_in_turn_and_raw(spark):
    df = spark.createDataFrame([("p", "w", 1.0), ("p", "w", None), ("q", "w", None), ("r", "z", None)], "p string, w string, v double")
    assert sorted(r.v for r in stats.impute(df, "v", [["p"], ["w"], []]).collect()) == [1, 1, 1, 1]
    assert sorted(r.v for r in stats.impute(df, "v", [["w"], []], raw=True).collect()) == [1, 1, 1, 1]


def test_ipf_meets_margins(spark):
    m = spark.createDataFrame([(n, i, float((n + 1) * (i + 2))) for n in range(3) for i in range(3)], "n int, i int, value double").withColumn("value", F.when((F.col("n") == 1) & (F.col("i") == 2), 0.0).otherwise(F.col("value")))
    r = spark.createDataFrame([(0, 10.0), (1, 20.0), (2, 30.0)], "n int, r double")
    c = spark.createDataFrame([(0, 12.0), (1, 18.0), (2, 30.0)], "i int, c double")
    out = od.ipf(m, r, c, rounds=100)
    assert [x[0] for x in out.groupBy("n").agg(F.sum("value").alias("s")).orderBy("n").select("s").collect()] == pytest.approx([10, 20, 30], abs=1e-6)


def test_gravity_recovers_phi(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=8), rng.normal(size=8)
    rows = [(n, i, 2.0 + abs(n - i) * (1.3 + n % 2)) for n in range(8) for i in range(8)]
    tau = spark.createDataFrame(rows, "n int, i int, tau double")
    flow = spark.createDataFrame([(n, i, float(np.exp(a[n] + b[i]) * t**-1.7)) for n, i, t in rows], "n int, i int, value double")
    for diagonal in (True, False):
        assert od.gravity(flow, tau, diagonal).first().phi == pytest.approx(1.7, abs=1e-8)


def test_spatial(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)]
    areas = spark.createDataFrame([(1, ring), (2, [(x + 4, y) for x, y in ring])], "aid int, ring array<struct<x:double,y:double>>")
    got = areas.select("aid", spatial.ring_area(F.col("ring")).alias("a"), spatial.ring_centroid(F.col("ring")).alias("c")).orderBy("aid").collect()
    assert (got[0].a, got[0].c.x, got[0].c.y) == pytest.approx((8, 2, 1))
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 1.0), (3, 50.0, 1.0)], "pid int, x double, y double")
    assert {r.pid: r.aid for r in spatial.points_in_areas(points, areas, 3.0).collect()} == {1: 1, 2: 2, 3: None}


def test_point_blob():
    blob = b"GP\x00\x01" + b"\0" * 4 + b"\x01" + struct.pack("<Idd", 1, 3.0, 4.0)
    assert tables.decode_point(blob) == (3.0, 4.0) and tables.decode_point(None) is None
    outer = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    hole = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    wkb = b"\x01" + struct.pack("<II", 3, 2) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in (outer, hole))
    assert tables.decode_polygon(b"GP\x00\x01" + b"\0" * 4 + wkb) == pytest.approx((2.0, 2.0, 15.0))


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 5.0), (4, 5, 1.0), (5, 4, 1.0), (1, 2, 9.0)], "u int, v int, time double").withColumn("len", F.col("time"))
    assert {r.node: r.scc for r in graph.strong_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    s = spark.createDataFrame([(1,), (4,)], "node int")
    t = {(r.o, r.d): r.sec for r in graph.travel_times(e, s, spark.createDataFrame([(i,) for i in range(1, 6)], "node int")).collect()}
    assert t[1, 5] == 8 and (4, 1) not in t
    r = {(x.o, x.d): x.sec for x in graph.relaxed(e, s, 5).collect()}
    assert r == t
    assert graph.giant(e).count() == 4


def test_identity_counterfactual():
    rng = np.random.default_rng(1)
    n = 4
    com = rng.uniform(1, 5, (n, n))
    lam0 = com / com.sum()
    w0 = np.ones(n)
    res, jobs = com.sum(1), com.sum(0)
    v0 = (com / res[:, None]) @ w0
    pi0 = np.tile((w0 * jobs / (v0 * res).sum())[:, None], (1, n))
    one = np.ones((n, n))
    out = model.counterfactual(np.ones(n), one, one, one, w0, v0, lam0, jobs, res, pi0)
    assert out["welfare"] == pytest.approx(1) and out["spread"] == pytest.approx(0, abs=1e-9)


def test_hedonic_matches_dummies(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(x), float(0.5 * x + g + rng.normal() / 10)) for g, x in zip(rng.integers(0, 5, 300), rng.normal(size=300))]
    out, beta = hedonic.fitted(spark.createDataFrame(rows, "g int, x double, y double"), "y", ["x"], "g")
    a = np.array(rows)
    full = np.column_stack([a[:, [0]] == k for k in range(5)] + [a[:, 1]]).astype(float)
    b = np.linalg.lstsq(full, a[:, 2], rcond=None)[0]
    assert beta["x"] == pytest.approx(b[-1], abs=1e-6)
    assert [r.theta for r in out.orderBy("g").collect()] == pytest.approx(list(b[:5]), abs=1e-6)


def test_stream(spark, tmp_path):
    e = spark.createDataFrame([(1, "a", 2.0, d) for d in ("2024-01-01 10:00:00", "2024-01-01 12:00:00", "2024-01-09 00:00:00")], "event_id int, event_type string, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(f"{tmp_path}/in")
    windows.run_once(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").where("n = 2").count() == 1


def test_run_artefact(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "code string, v double")
    m = tables.write_run({"vectors": df}, f"{tmp_path}/run", {"alpha": 0.7})
    assert m["sections"]["vectors"]["rows"] == 1 and "alpha" in spark.read.text(f"{tmp_path}/run/manifest").first()[0]
    assert "\\begin{tabular}" in tables.latex(df, "x")


def test_wide_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text('Kod;Nazwa;"praca;ogółem;2020;[zł]";"praca;ogółem;2021;[zł]"\n0201000;X;"1 234,5";0\n')
    got = tables.wide_csv(spark, str(tmp_path / "w.csv"), ["kind", "total", "year"], "[zł]").orderBy("year").collect()
    assert [(r.kod, r.year, r.value) for r in got] == [("0201000", "2020", 1234.5), ("0201000", "2021", None)]
