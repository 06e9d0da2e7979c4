"""Wide statistical files, house frames, sinks, settings and small checks on hand-made tables."""

from __future__ import annotations

import json

import pytest

from terrano.operators import reports, transactions
from terrano.sources import sinks, statistics


def write(tmp_path, name, header, rows):
    lines = [";".join(['"Kod"', '"Nazwa"', *[f'"{h}"' for h in header]]), *[";".join([c, n, *v]) for c, n, *v in rows]]
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8-sig")
    return str(path)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_wages(spark, tmp_path):
    p = write(tmp_path, "w.csv", ["ogółem;2011;[zł]", "ogółem;2012;[zł]"], [("0201000", "P", "3 000,50", "0"), ("0201011", "G", "1", "1"), ("0200000", "W", "2", "2")])
    assert rows(statistics.county_wages(spark, p), "powiat", "year") == [("0201", 2011), ("0201", 2012)]
    assert {r.year: r.wage for r in statistics.county_wages(spark, p).collect()} == {2011: 3000.5, 2012: None}
    p = write(tmp_path, "m.csv", ["marzec;wg siedziby podmiotu;ogółem;2021;[zł]", "marzec;wg miejsca zamieszkania;ogółem;2021;[zł]", "rok;wg siedziby podmiotu;ogółem;2021;[zł]"], [("0201011", "G", "5", "6", "7"), ("0201000", "P", "5", "6", "7")])
    assert rows(statistics.commune_wages(spark, p), "code6", "concept", "year", "month", "wage") == [("020101", "residence", 2021, 3, 6.0), ("020101", "workplace", 2021, 3, 5.0)]


def test_people(spark, tmp_path):
    p = write(tmp_path, "e.csv", ["ogółem;2011;[osoba]", "ogółem;2012;[osoba]"], [("0201011", "G", "10", "0"), ("0201014", "part", "9", "9")])
    got = {(r.code6, r.year): r.emp for r in statistics.jobs(spark, p).collect()}
    assert got == {("020101", 2011): 10.0, ("020101", 2012): None}
    p = write(tmp_path, "r.csv", ["styczeń;pracujący;ogółem;2022;[osoba]"], [("0201011", "G", "10")])
    assert rows(statistics.employed_residents(spark, p), "code6", "year", "month", "emp") == [("020101", 2022, 1, 10.0)]
    p = write(tmp_path, "a.csv", ["w wieku produkcyjnym;ogółem;2021;[osoba]", "w wieku nieprodukcyjnym;ogółem;2021;[osoba]"], [("0201011", "G", "7", "3"), ("0201023", "H", "", "3")])
    assert {r.code6: r.workage for r in statistics.working_age(spark, p).collect()} == {"020101": 7.0, "020102": None}
    p = write(tmp_path, "c.csv", ["praca najemna;ogółem;2021;[osoba]", "dochody z pracy;ogółem;2021;[osoba]", "emerytura;ogółem;2021;[osoba]"], [("0201000", "P", "1", "2", "50"), ("0202000", "Q", "", "0", "50")])
    assert {r.powiat: r.income_earners for r in statistics.earners(spark, p).collect()} == {"0201": 3.0, "0202": None}


def test_prices_and_stock(spark, tmp_path):
    head = ["rynek pierwotny;ogółem;2011;[zł]", "rynek wtórny;ogółem;2011;[zł]"]
    a, b = write(tmp_path, "p1.csv", head, [("0201000", "P", "100", "0")]), write(tmp_path, "p2.csv", head, [("0201000", "P", "110", "120"), ("0200000", "W", "1", "1")])
    got = {r.market: (r.year, r.median, r.mean) for r in statistics.price_levels(spark, a, b).collect()}
    assert got == {"rynek pierwotny": (2011, 100.0, 110.0), "rynek wtórny": (2011, None, 120.0)}
    p = write(tmp_path, "s.csv", ["ogółem;mieszkania;2011;[-]", "ogółem;izby;2011;[-]"], [("0201011", "G", "40", "90"), ("0201014", "part", "10", "20"), ("0201000", "P", "40", "1")])
    assert rows(statistics.housing_stock(spark, p), "gmina", "year", "dwellings") == [("0201011", 2011, 40.0)]


def test_house_frame(spark):
    df = spark.createDataFrame([("t1", 100.0, 2020, 1.0)], "tran string, price double, year int, rooms double")
    out = transactions.as_houses(df)
    r = out.first()
    assert (r.tran, r.kind, r.price, r.rooms, r.plot) == ("t1", "house", 100.0, None, None)
    assert transactions.as_houses(df.where("false")).dtypes == out.dtypes


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.0, 1), ("a", 1.0, 2)], "code string, v double, part int")
    sinks.write_index(df, f"{tmp_path}/i", ["code", "v"], "code")
    assert [r.code for r in spark.read.option("header", True).csv(f"{tmp_path}/i/csv").collect()] == ["a", "b"]
    sinks.write_parts(df, f"{tmp_path}/p", ["part"])
    sinks.write_parts(df.where("part = 1").withColumn("v", df.v * 10), f"{tmp_path}/p", ["part"])
    assert rows(spark.read.parquet(f"{tmp_path}/p"), "code", "v") == [("a", 1.0), ("b", 20.0)]
    make = lambda k: df.where(df.part == k)
    assert sinks.resumed(spark, [1], make, f"{tmp_path}/r") == [1] and sinks.resumed(spark, [1, 2], make, f"{tmp_path}/r") == [2]
    od = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 2.0), ("b", "a", 3.0)], "n string, i string, tau double")
    sinks.write_matrix(od, f"{tmp_path}/m", "tau", {"units": 2})
    assert spark.read.parquet(f"{tmp_path}/m/matrix").count() == 3 and json.loads(spark.read.text(f"{tmp_path}/m/meta").first()[0]) == {"units": 2}
    assert rows(sinks.wide_matrix(od, "tau", ["a", "b"]).na.fill(0.0), "n", "a", "b") == [("a", 1.0, 2.0), ("b", 3.0, 0.0)]
    sinks.write_tidy({2011: df}, od, {"lost": 0}, f"{tmp_path}/t")
    assert spark.read.option("header", True).csv(f"{tmp_path}/t/year=2011").count() == 2


def test_settings_and_order(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"alpha": 0.6}))
    got = sinks.Settings.read(str(path))
    assert got.alpha == 0.6 and got.epsi == 4.6 and got.root == str(tmp_path) and sinks.Settings.read(str(path), "x").root == "x"
    path.write_text(json.dumps({"beta": 1}))
    with pytest.raises(ValueError):
        sinks.Settings.read(str(path))
    assert reports.solve_order({2011: 2021, 2021: None, 2026: 2021}) == [2021, 2011, 2026]
    with pytest.raises(ValueError):
        reports.solve_order({1: 2, 2: 1})


def test_time_dummies(spark):
    from terrano.operators import hedonic

    df = spark.createDataFrame([(str(y), float(y)) for y in (2019, 2020, 2021)], "year string, v double")
    out, names = hedonic.time_dummies(df, "year", "2021")
    assert names == ["t_0", "t_1"] and rows(out, "year", "t_0", "t_1") == [("2019", 1.0, 0.0), ("2020", 0.0, 1.0), ("2021", 0.0, 0.0)]
    assert hedonic.time_dummies(df, "year", "1999")[1] == ["t_0", "t_1"]
