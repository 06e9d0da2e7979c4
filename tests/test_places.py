"""Covariates, comparisons and invariants on small tables."""

import math

import pytest

from terrano.operators import covariates, model, od, reports, stats


def test_covariates_fill_land_and_anchor_from_raw_medians(spark):
    places = spark.createDataFrame([("0201011", 100.0), ("0201023", 0.5), ("0202012", None), ("0401011", 7.0)], "code string, pop double")
    land = spark.createDataFrame([("0201011", 2.0), ("0401011", 4.0)], "code string, log_land double")
    anchor = spark.createDataFrame([("0201", 1000.0)], "county string, anchor double")
    got = {r.code: r for r in covariates.place_covariates(places, land, anchor).collect()}
    assert got["0201023"].log_land == 2.0 and got["0202012"].log_land == 3.0 and got["0201023"].log_pop == 0.0 and got["0202012"].pop is None
    assert got["0202012"].anchor is None and got["0202012"].log_anchor == got["0401011"].log_anchor == pytest.approx(math.log(1000))
    assert got["0201023"].urban_rural == 1.0 and got["0201011"].urban == 1.0
    jobs = covariates.job_covariates(places, spark.createDataFrame([("0201011", 0.2)], "code string, jobs double")).collect()
    assert all(r.jobs == 1.0 and r.log_jobs == 0.0 for r in jobs) and len(jobs) == 4


def test_area_is_null_without_a_code_column(spark):
    frame = spark.createDataFrame([("0000001",)], "code string")
    assert covariates.with_area(frame, spark.createDataFrame([(1.0,)], "m2 double")).first().area_km2 is None
    assert covariates.with_area(frame, spark.createDataFrame([(3e6, 1), (2e6, 1)], "m2 double, KOD int")).first().area_km2 == 2.0


def test_log_changes_and_origin_rows(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 5.0)], "k int, v double")
    b = spark.createDataFrame([(1, math.e), (2, 1.0)], "k int, v double")
    got = {r.k: r.d_v for r in reports.log_changes(a, b, "k", ["v"]).collect()}
    assert got == {1: pytest.approx(1.0), 2: None}
    assert [r.log_v for r in reports.levels(a, "k", ["v"]).orderBy("k").collect()] == [0.0, None, pytest.approx(math.log(5))]
    runs = spark.createDataFrame([(1, 1, 3.0, 2.0), (1, 2, 1.0, None), (2, 1, 9.0, 9.0)], "n int, i int, a double, b double")
    assert [(r.i, r.change) for r in reports.from_origin(runs, 1).collect()] == [(2, None), (1, -1.0)]


def test_invariants_fail_where_they_should(spark):
    good = [(1.0, 1.5, 2.0, 2.0, 0.5), (1.0, 0.5, 1.0, 0.5, 0.5)]
    s = spark.createDataFrame(good, "l double, r double, a double, b double, uncond double")
    tau = spark.createDataFrame([(1.0,), (float("inf"),)], "tau double")
    got = {r.check: r.passed for r in model.invariants(s, 2.0, tau, spark.createDataFrame([(10.0, 10.005)], "income double, expenditure double")).collect()}
    assert got == {"jobs": True, "residents": True, "shares": True, "productivity": True, "amenity": True, "times": False, "income": True}
    got = {r.check: r.passed for r in model.invariants(s.withColumn("a", s.a - 1).withColumn("b", s.b * 2), 3.0).collect()}
    assert got == {"jobs": False, "residents": False, "shares": True, "productivity": False, "amenity": False}
    assert not any(r.passed for r in model.invariants(s.limit(0), 2.0).collect())


def test_effective_cost_is_a_seam(spark):
    tau = spark.createDataFrame([(1.0,)], "tau double")
    assert od.effective_cost(tau) is tau
    with pytest.raises(NotImplementedError):
        od.effective_cost(tau, modes=[{}])
    with pytest.raises(NotImplementedError):
        od.effective_cost(tau, congestion={})


def test_impute_over_all_rows_needs_no_window(spark):
    x = spark.createDataFrame([(1, 1.0), (2, None), (3, 9.0), (4, 2.0)], "k int, v double")
    got = stats.impute(x, "v", [[]])
    assert {r.k: r.v for r in got.collect()}[2] == 2.0 and "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
