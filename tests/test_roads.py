"""Road networks against plain figures."""

import math

import pytest
from pyspark.sql import functions as F

from terrano.functions import parse
from terrano.operators import roads, spatial

WAYS = "way string, refs array<long>, lons array<double>, lats array<double>, road string, maxspeed string, oneway string, junction string, lanes string, zone string"
TAGGED = ("way string, refs array<long>, lons array<double>, lats array<double>, highway string, motor_vehicle string, motorcar string, access string, source_maxspeed string, "
          "zone_maxspeed string, zone_traffic string, maxspeed_type string, maxspeed string, oneway string, junction string, lanes string")
LINES = "line string, cls string, label string, planned int, no_car int, kmh int, oneway int, oneway_net int, nodes string, lons array<double>, lats array<double>"


def meridian(a, b, n=2000):
    e2, h = 0.0066943799901413165, math.radians(b - a) / n
    at = [6378137 * (1 - e2) / (1 - e2 * math.sin(math.radians(a) + k * h) ** 2) ** 1.5 for k in range(n + 1)]
    return h / 3 * (at[0] + at[-1] + 4 * sum(at[1:-1:2]) + 2 * sum(at[2:-1:2]))


def test_ground_metres_follow_the_ellipsoid(spark):
    lit = [F.lit(v) for v in (19.0, 50.0, 19.0, 50.2)]
    got = spark.range(1).select(spatial.ground_metres(*lit).alias("m")).first().m
    assert got == pytest.approx(meridian(50.0, 50.2), rel=1e-6)


def test_drivable_keeps_open_ways_with_two_placed_vertices(spark):
    def row(way, highway, mv=None, access=None, lons=(1.0, 2.0), zone=None):
        return (way, list(range(len(lons))), list(lons), [50.0] * len(lons), highway, mv, "", access, "", zone, None, "x", "50", " Yes ", None, None)
    rows = [row("a", "primary"), row("b", "track"), row("c", "primary", access="private"), row("d", "primary", mv="yes", access="no"), row("e", "service", lons=(1.0, None)),
            row("f", "service", lons=(1.0, None, 3.0), zone="PL:urban"), row("g", None)]
    got = {r.way: r for r in roads.drivable(spark.createDataFrame(rows, TAGGED)).collect()}
    assert sorted(got) == ["a", "d", "f"]
    assert got["f"].refs == [0, 2] and got["f"].zone == "PL:urban" and got["a"].zone == "x" and got["a"].oneway == "yes"


def test_profile_and_ambiguous_classes():
    own = roads.profile({"motorway": [130, 110]})
    assert own["motorway"] == (130.0, 110.0) and own["primary"] == (90.0, 60.0)
    assert "motorway" not in roads.ambiguous(roads.profile()) and "motorway" in roads.ambiguous(own) and "service" not in roads.ambiguous(own)


def test_built_up_by_zone_cell_area_and_class(spark):
    def row(way, road, tag=None, zone=None, lon=0.0):
        return (way, [1, 2, 3], [lon - 1, lon, lon + 1], [0.0, 0.0, 0.0], road, tag, "", "", None, zone)
    x = spark.createDataFrame([row("near", "primary"), row("far", "primary", lon=50.0), row("rural", "residential", zone="pl:RURAL"), row("tag", "residential", tag="30"), row("house", "residential", lon=50.0), row("none", None)], WAYS)
    cells = spark.createDataFrame([(1, 0.4, 0.3)], "rid long, x double, y double")
    plain = lambda lon, lat: (lon, lat)
    got = {r.way: (r.asked, r.urban) for r in roads.built_up(x, roads.profile(), cells=cells, cell_size=0.5, metric=plain).collect()}
    assert got == {"near": (True, True), "far": (True, False), "rural": (True, False), "tag": (False, True), "house": (True, False), "none": (False, False)}
    ring = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
    areas = spark.createDataFrame([("u", ring)], "aid string, ring array<struct<x:double,y:double>>")
    got = {r.way: r.urban for r in roads.built_up(x, roads.profile(), areas=areas, tile=1.0, metric=plain).collect()}
    assert got == {"near": True, "far": False, "rural": False, "tag": True, "house": False, "none": False}
    got = {r.way: (r.asked, r.urban) for r in roads.built_up(x, roads.profile(), infer=False).collect()}
    assert got["house"] == (False, True) and got["near"] == (False, False)
    got = {r.way: r.asked for r in roads.built_up(x, roads.profile(), use_tags=False).collect()}
    assert got["tag"] and got["near"]


def test_edges_directions_lanes_and_speeds(spark):
    def row(way, road, tag=None, oneway="", junction="", lanes=None, refs=(1, 2, 2)):
        return (way, list(refs), [19.0, 19.1, 19.2][:len(refs)], [50.0] * len(refs), road, tag, oneway, junction, lanes, None)
    x = spark.createDataFrame([row("two", "primary", tag="72"), row("rev", "primary", oneway="-1"), row("m", "motorway", lanes="0.4;9"), row("r", "tertiary", junction="roundabout"), row("no", "motorway", oneway="no", lanes="nan"), row("one", "primary", refs=(1,))], WAYS).withColumn("urban", F.lit(True))
    e = roads.edges(x, roads.profile(), 0.5).collect()
    got = {}
    for r in e:
        got.setdefault(r.way, set()).add((r.u, r.v, r.cap))
    assert got == {"two": {(1, 2, 2800.0), (2, 1, 2800.0)}, "rev": {(2, 1, 2800.0)}, "m": {(1, 2, 2000.0)}, "r": {(1, 2, 900.0)}, "no": {(1, 2, 4000.0), (2, 1, 4000.0)}}
    speed = {r.way: r.len / r.time * 3.6 for r in e}
    assert speed["two"] == pytest.approx(72) and speed["rev"] == pytest.approx(30) and speed["m"] == pytest.approx(70)
    assert {r.way: r.len / r.time * 3.6 for r in roads.edges(x, roads.profile(), 1.0, use_tags=False).collect()}["two"] == pytest.approx(60)


def test_navigation_lines_split_at_their_nodes(spark):
    lons = [19.0, 19.1, 19.2, 19.3]
    rows = [("a", "trunk", "", 0, None, 80, None, 1, "[2, 2, 9]", lons, [50.0] * 4), ("b", "residential", "A4", None, 0, None, 0, 1, "not json", lons, [50.0] * 4),
            ("p", "primary", None, 1, 0, 50, 0, 0, None, lons, [50.0] * 4), ("n", "primary", None, 0, 1, 50, 0, 0, None, lons, [50.0] * 4),
            ("x", "ferry", None, 0, 0, 50, 0, 0, None, lons, [50.0] * 4), ("loop", "primary", None, 0, 0, 50, 0, 0, None, [19.0, 19.1, 19.0], [50.0] * 3), ("dot", "primary", None, 0, 0, 50, 0, 0, None, [19.0], [50.0])]
    lines = spark.createDataFrame(rows, LINES)
    got = {r.way: r for r in roads.navigation_ways(lines).collect()}
    assert sorted(got) == ["a-0", "a-1", "b-0"]
    a, b = got["a-0"], got["b-0"]
    assert a.road == "primary" and a.maxspeed == "80" and a.oneway == "yes" and a.lons == [19.0, 19.2]
    assert b.road == "motorway" and b.maxspeed == "140" and b.oneway == "no" and b.refs == [a.refs[0], got["a-1"].refs[1]]
    assert a.metres + got["a-1"].metres == pytest.approx(b.metres) and a.refs[0] == 19_000_000 * 1_000_000_000 + 50_000_000
    e = roads.edges(roads.built_up(roads.navigation_ways(lines, numbered=False), roads.profile()), roads.profile()).where("way = 'b-0'").collect()
    assert len(e) == 2 and e[0].len == pytest.approx(b.metres) and e[0].len / e[0].time * 3.6 == pytest.approx(40)


def test_coverage_of_tags(spark):
    x = spark.createDataFrame([("a", [1, 2], [19.0, 19.1], [50.0, 50.0], "primary", "50", "", "", None, None), ("b", [1, 2], [19.0, 19.1], [50.0, 50.0], "primary", None, "", "", None, "PL:urban")], WAYS)
    r = roads.coverage(roads.built_up(x, roads.profile())).first()
    assert r.tagged == pytest.approx(r.metres / 2) and r.asked == r.urban == pytest.approx(r.metres / 2)
    assert parse.UNKNOWN_SPEED == 40
