"""Projections, file sources, tilings, breaks, crosswalks and rules on small hand-made tables."""

from __future__ import annotations

import itertools
import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrano.functions import parse, projection
from terrano.operators import relational, spatial, stats
from terrano.sources import files


def test_projections_at_known_points(spark):
    df = spark.createDataFrame([(0, 5.0, 50.0), (1, 10.0, 52.0), (2, 19.0, 0.0)], "k int, lon double, lat double")
    x, y = projection.to_laea(F.col("lon"), F.col("lat"))
    e, n = projection.to_tm(F.col("lon"), F.col("lat"))
    got = df.select("k", x.alias("x"), y.alias("y"), e.alias("e"), n.alias("n")).orderBy("k").collect()
    assert (got[0].x, got[0].y) == pytest.approx((3962799.45, 2999718.85), abs=0.01)  # the published example of this grid
    assert (got[1].x, got[1].y) == pytest.approx((4321000, 3210000), abs=1e-6)
    assert (got[2].e, got[2].n) == pytest.approx((500000, -5300000), abs=1e-6)


def test_transverse_mercator_is_conformal_and_returns(spark):
    df = spark.createDataFrame([(14.2, 49.1), (19.0, 52.0), (24.0, 54.8), (21.01, 52.23)], "lon double, lat double")
    for there, back in ((projection.to_laea, projection.from_laea), (projection.to_tm, projection.from_tm)):
        x, y = there(F.col("lon"), F.col("lat"))
        lon, lat = back(F.col("x"), F.col("y"))
        far = df.withColumns({"x": x, "y": y}).select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
        assert max(far) < 1e-8
    h = 1e-4
    a = df.select(*[c for p, q in ((0, 0), (h, 0), (0, h)) for c in projection.to_tm(F.col("lon") + p, F.col("lat") + q)]).collect()
    for r in a:
        east, north = np.subtract(r[2:4], r[0:2]), np.subtract(r[4:6], r[0:2])
        assert abs(east @ north) / np.linalg.norm(east) / np.linalg.norm(north) < 1e-5


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    con = sqlite3.connect(path)
    con.execute('CREATE TABLE lokale (fid INTEGER PRIMARY KEY, "nier cena" TEXT, area REAL, geom BLOB)')
    con.execute("CREATE TABLE none (fid INTEGER PRIMARY KEY, area REAL, geom BLOB)")
    con.executemany("INSERT INTO lokale VALUES (?, ?, ?, ?)", [(i, None if i == 7 else f"p{i}", i / 2, b"GP") for i in range(5, 40, 2)])
    con.commit()
    con.close()
    df = files.geopackage(spark, path, "lokale", ["nier cena", "area"], where="area < 15", chunk=10)
    rows = {r.fid: r for r in df.collect()}
    assert sorted(rows) == list(range(5, 30, 2)) and df.rdd.getNumPartitions() == 4
    assert rows[7]["nier cena"] is None and rows[9]["area"] == "4.5" and bytes(rows[9].geom) == b"GP"
    assert files.geopackage(spark, path, "none", ["area"]).count() == 0


def test_matrix_bundle(spark, tmp_path):
    m = np.array([[1.0, np.nan], [3.0, 4.0]], dtype=np.float32)
    np.savez(tmp_path / "a.npz", tau=m, ids=np.array(["0201011", "0201022"]))
    got = {(r.n, r.i): r.value for r in files.matrix_bundle(spark, str(tmp_path / "a.npz")).collect()}
    assert got == {("0201011", "0201011"): 1, ("0201022", "0201011"): 3, ("0201022", "0201022"): 4}


def test_spreadsheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="x" r:id="r1"/><sheet name="flows" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>res</t></si><si><r><t>02</t></r><r><t>01</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2" t="inlineStr"><is><t>w</t></is></c><c r="AA2"><v>12</v></c></row><row/></sheetData></worksheet>')
    got = files.spreadsheet(spark, str(tmp_path / "a.xlsx"), {"res": 0, "work": 2, "count": 26}, "flows", skip=1).collect()
    assert [tuple(r) for r in got] == [("0201", "w", "12")]


def test_merged_tiles(spark):
    a = spark.createDataFrame([("1", "a"), (None, "n"), (None, "n")], "gml_id string, v string")
    b = spark.createDataFrame([("1", "x", 1), ("2", "b", 2)], "gml_id string, v string, more int")
    assert sorted(map(str, files.merged_tiles([a, b]).collect())) == sorted(map(str, spark.createDataFrame([("1", "a"), ("2", "b"), (None, "n"), (None, "n")], "gml_id string, v string").collect()))


def test_natural_breaks_against_all_partitions(spark):
    v = [1.0, 1.0, 2.0, 4.0, 4.5, 9.0, 9.5, 10.0, 30.0]
    df = spark.createDataFrame([(x,) for x in [*v, None, float("nan")]], "v double")
    got = stats.natural_breaks(df, "v", 3).orderBy("class").collect()
    spread = lambda cuts: sum(np.var(p) * len(p) for p in np.split(v, cuts))
    best = min((c for c in itertools.combinations(range(1, len(v)), 2)), key=spread)
    assert [r.n for r in got] == [len(p) for p in np.split(v, best)] and [r.upper for r in got] == [p[-1] for p in np.split(v, best)]
    assert stats.natural_breaks(df.where("false"), "v").count() == 0
    assert [tuple(r) for r in stats.natural_breaks(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v").collect()] == [(1, 2.0, 2)]


def test_natural_breaks_of_many_values(spark):
    df = spark.range(20_000).select((F.col("id") + F.when(F.col("id") >= 12_000, 10**6).otherwise(0)).cast("double").alias("v"))
    assert [(r.upper, r.n) for r in stats.natural_breaks(df, "v", 2).orderBy("class").collect()] == [(11_999.0, 12_000), (1_019_999.0, 8_000)]


def test_quadtree(spark):
    rows = [(i, 1.0 + i / 100, 1.0) for i in range(30)] + [(100, 7.0, 7.0), (101, 8.0, 8.0), (102, 9.0, 9.0)]
    got = {r.tile: r.n for r in spatial.quadtree(spark.createDataFrame(rows, "pid int, x double, y double"), (0.0, 0.0, 8.0, 8.0), most=10, depth=2, side=0.1).collect()}
    assert got == {"2_0_0": 30, "1_1_1": 2}
    assert spatial.quadtree(spark.createDataFrame(rows[:0] or [], "pid int, x double, y double"), (0.0, 0.0, 8.0, 8.0)).count() == 0


def test_crosswalk_and_shares(spark):
    codes = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "src string")
    frame = spark.createDataFrame([("a",), ("x",), ("y",)], "dst string")
    special = spark.createDataFrame([("b", "x", 3.0), ("b", "y", 1.0), ("z", "x", 1.0)], "src string, dst string, weight double")
    assert sorted(map(tuple, relational.crosswalk(codes, frame, special).collect())) == [("a", "a", 1.0), ("b", "x", 0.75), ("b", "y", 0.25)]
    with pytest.raises(ValueError):
        relational.crosswalk(codes, frame.where("dst != 'a'"), special)
    df = spark.createDataFrame([("k", 1, 0.0), ("k", 2, 0.0), ("m", 1, 3.0), ("m", 2, 1.0), ("m", 3, 9.0)], "k string, o int, w double")
    assert sorted((r.k, r.o, r.share) for r in relational.top_shares(df, "k", [F.asc("o")], "w", 2).collect()) == [("k", 1, 0.5), ("k", 2, 0.5), ("m", 1, 0.75), ("m", 2, 0.25)]


def test_rules(spark):
    rows = spark.createDataFrame([("motorway", "A2", 100), ("secondary", "S17 ", None), ("trunk", None, 90), ("cycleway", "x", None), (None, None, None)], "cls string, label string, kmh int")
    got = rows.select(parse.map_class(F.col("cls"), F.col("label")).alias("c"), parse.numbered_speed(F.col("kmh"), F.col("label")).alias("v")).collect()
    assert [tuple(r) for r in got] == [("motorway", 140), ("trunk", 120), ("primary", 90), (None, None), (None, None)]
    text = spark.createDataFrame([('<a numberMatched="12" numberReturned="unknown"/>',)], "s string").select(parse.reply_count(F.col("s"), "numberMatched"), parse.reply_count(F.col("s"), "numberReturned"), parse.labelled(F.col("s"), 4)).first()
    assert tuple(text) == (12, None, "<a …")
    ratios = spark.createDataFrame([("a", 0.5)] * 3 + [("a", 1.2), ("b", 0.9), ("c", float("nan"))], "k string, r double")
    assert {r.k: (r.n, r["__k"]) for r in stats.calibration_factor(ratios.withColumnRenamed("k", "g"), "g", "r", least=3).toDF("k", "n", "__k").collect()} == {"a": (3, 0.5), "b": (1, 0.5), "c": (0, 0.5)}
    assert tuple(stats.diverging_limits(ratios.where("false"), "r").first()) == (-1, 1)
