"""Road networks: which ways are driven, which lie in built-up areas, and the directed edges they make.

Ways are rows (way, refs, lons, lats, road, maxspeed, oneway, junction, lanes, zone), with metres where
the length of the whole way is known already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse, projection
from .spatial import ground_metres, nearest_within, points_in_areas

#: Access tags that bar cars.
BARRED = ["no", "private", "agricultural", "forestry", "delivery", "customers"]
#: Classes that are built-up unless something else is known.
SETTLED = ["residential", "living_street", "service"]

Profile = dict[str, tuple[float, float]]


def profile(overrides: dict | None = None) -> Profile:
    """(rural, urban) km/h by class; classes in overrides replace the defaults."""
    return {c: (float(r), float(u)) for c, r, u, _ in parse.ROADS} | {c: (float(v[0]), float(v[1])) for c, v in (overrides or {}).items()}


def ambiguous(speeds: Profile) -> list[str]:
    """Classes for which it matters whether a way is in a built-up area."""
    return [c for c, (r, u) in speeds.items() if r != u]


def _first(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names])


def drivable(tagged: DataFrame) -> DataFrame:
    """Ways of tagged ones (way, refs, lons, lats, highway, motor_vehicle, motorcar, access, source_maxspeed, zone_maxspeed,
    zone_traffic, maxspeed_type, maxspeed, oneway, junction, lanes): of a known class, open to cars, with two placed vertices at least."""
    x = tagged.where(F.col("highway").isin([c for c, *_ in parse.ROADS]) & ~F.coalesce(_first("motor_vehicle", "motorcar", "access").isin(BARRED), F.lit(False)))
    p = F.filter(F.arrays_zip("refs", "lons", "lats"), lambda v: v["lons"].isNotNull() & v["lats"].isNotNull())
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    x = x.withColumn("__p", p).where(F.size("__p") >= 2)
    return x.select("way", F.col("__p.refs").alias("refs"), F.col("__p.lons").alias("lons"), F.col("__p.lats").alias("lats"), F.col("highway").alias("road"), "maxspeed",
                    low(F.col("oneway")).alias("oneway"), low(F.col("junction")).alias("junction"), "lanes", _first("source_maxspeed", "zone_maxspeed", "zone_traffic", "maxspeed_type").alias("zone"))


def _segments(*of: str) -> Column:
    """An array of (p, q): each vertex (refs, lons, lats, or what is named) and its successor on the way."""
    p = F.arrays_zip(*of)
    return F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("p"), b.alias("q")))


def _metres(s: Column) -> Column:
    return ground_metres(s["p"]["lons"], s["p"]["lats"], s["q"]["lons"], s["q"]["lats"])


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)


def navigation_ways(lines: DataFrame, numbered: bool = True) -> DataFrame:
    """Ways between the routing nodes of a navigation map's lines (line, cls, label, planned, no_car, kmh, oneway, oneway_net, nodes, lons, lats).

    nodes is a JSON list of vertex positions; both ends are nodes in any case.  A node's reference is its place to six decimals,
    so that lines of neighbouring tiles meet without a join.  Parts without length or from a node to itself are dropped.
    """
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    x = lines.where(F.col("cls").isNotNull() & ~yes("planned") & ~yes("no_car") & (F.size("lons") >= 2))
    x = x.withColumn("road", parse.map_class(F.col("cls"), F.col("label"), numbered)).where("road IS NOT NULL")
    last = F.size("lons") - 1
    stated = F.coalesce(F.from_json("nodes", "array<int>"), F.array().cast("array<int>"))
    stops = F.array_sort(F.array_distinct(F.concat(F.filter(stated, lambda n: n.between(0, last)), F.array(F.lit(0), last))))
    kmh = F.col("kmh").cast("int")
    x = x.withColumns({"stops": stops, "steps": F.transform(_segments("lons", "lats"), _metres), "kmh": (parse.numbered_speed(kmh, F.col("label")) if numbered else kmh).cast("int").cast("string")})
    x = x.select("*", F.posexplode(F.zip_with(F.slice("stops", 1, F.size("stops") - 1), F.slice("stops", 2, F.size("stops") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("part", "s"))
    a, b = F.col("s.a"), F.col("s.b")
    at = lambda c: F.array(F.get(c, a), F.get(c, b))
    place = F.transform(F.arrays_zip(at("lons").alias("x"), at("lats").alias("y")), lambda p: F.bround(p["x"] * 1e6).cast("long") * 1_000_000_000 + F.bround(p["y"] * 1e6).cast("long"))
    x = x.select(F.concat_ws("-", "line", "part").alias("way"), place.alias("refs"), at("lons").alias("lons"), at("lats").alias("lats"), "road", F.col("kmh").alias("maxspeed"),
                 F.when(F.coalesce(F.col("oneway").cast("boolean"), F.col("oneway_net").cast("boolean"), F.lit(False)), "yes").otherwise("no").alias("oneway"),
                 F.lit("").alias("junction"), F.lit(None).cast("string").alias("lanes"), F.lit(None).cast("string").alias("zone"), _sum(F.slice("steps", a + 1, b - a)).alias("metres"))
    return x.where((F.col("metres") > 0) & (F.get("refs", F.lit(0)) != F.get("refs", F.lit(1))))


def built_up(ways: DataFrame, speeds: Profile, use_tags: bool = True, infer: bool = True, cells: DataFrame | None = None, cell_size: float = 1000.0,
             areas: DataFrame | None = None, tile: float = 10_000.0, metric: Callable = projection.to_tm) -> DataFrame:
    """The ways with `asked` (their speed depends on built-up areas) and `urban`.

    Where asked, the zone tag decides; without one the middle vertex does: a populated cell's centre (cells: rid, x, y) within
    cell_size, or an urban area (areas: aid, ring) that holds it.  Else the class does.  With infer off nothing is asked.
    """
    tagged = parse.max_speed(F.col("maxspeed")).isNotNull() if use_tags else F.lit(False)
    x = ways.withColumn("asked", F.lit(infer) & F.coalesce(F.col("road").isin(ambiguous(speeds)), F.lit(False)) & ~tagged)
    x = x.withColumn("__zone", F.when(F.col("asked"), parse.builtup(F.nullif(F.col("zone"), F.lit("")))))
    settled = F.coalesce(F.col("road").isin(SETTLED), F.lit(False))
    if cells is None and areas is None:
        return x.withColumn("urban", F.coalesce("__zone", settled)).drop("__zone")
    mid = F.floor(F.size("lons") / 2).cast("int")
    east, north = metric(F.col("lon"), F.col("lat"))
    points = x.where("asked AND __zone IS NULL").select("way", F.get("lons", mid).alias("lon"), F.get("lats", mid).alias("lat")).select("way", east.alias("x"), north.alias("y"))
    if cells is not None:
        hit = nearest_within(points.withColumnRenamed("way", "lid"), cells, cell_size).select(F.col("lid").alias("way"))
    else:
        hit = points_in_areas(points.withColumnRenamed("way", "pid"), areas, tile, "inner").select(F.col("pid").alias("way"))
    x = x.join(hit.distinct().withColumn("__hit", F.lit(True)), "way", "left")
    return x.withColumn("urban", F.when(F.col("asked") & F.col("__zone").isNull(), F.col("__hit").isNotNull()).otherwise(F.coalesce("__zone", settled))).drop("__zone", "__hit")


def edges(ways: DataFrame, speeds: Profile, factor: float = 1.0, use_tags: bool = True) -> DataFrame:
    """Directed edges (way, u, v, len, time, cap) of ways with `urban`: no shuffle, vertices meet their successors within the row."""
    by_class = parse.class_speed(F.col("road"), F.col("urban"), factor, speeds)
    kmh = F.coalesce(parse.max_speed(F.col("maxspeed")), by_class) if use_tags else by_class
    fwd, back = parse.directions(F.col("oneway"), F.col("junction"), F.col("road"))
    x = ways.withColumns({"kmh": kmh, "fwd": fwd, "back": back, "cap": parse.lane_capacity(F.col("road"), F.col("lanes"), ~back)})
    known = [F.col("metres")] if "metres" in ways.columns else []
    x = x.select("way", "kmh", "fwd", "back", "cap", *known, F.explode(_segments("refs", "lons", "lats")).alias("s"))
    x = x.withColumn("len", F.coalesce(*known, _metres(F.col("s")))).where((F.col("len") > 0) & (F.col("s.p.refs") != F.col("s.q.refs")))
    x = x.withColumn("time", parse.edge_seconds(F.col("len"), F.col("kmh")))
    ends = F.concat(F.when(F.col("fwd"), F.array(F.struct(F.col("s.p.refs").alias("u"), F.col("s.q.refs").alias("v")))).otherwise(F.array()),
                    F.when(F.col("back"), F.array(F.struct(F.col("s.q.refs").alias("u"), F.col("s.p.refs").alias("v")))).otherwise(F.array()))
    return x.select("way", F.explode(ends).alias("e"), "len", "time", "cap").select("way", "e.u", "e.v", "len", "time", "cap")


def coverage(ways: DataFrame, use_tags: bool = True) -> DataFrame:
    """(road, metres, tagged, asked, urban) by class: metres in all, with a speed tag in use, of ways that asked, and of those in built-up areas."""
    whole = _sum(F.transform(_segments("lons", "lats"), _metres))
    x = ways.withColumn("m", F.coalesce(F.col("metres"), whole) if "metres" in ways.columns else whole)
    tag = parse.max_speed(F.col("maxspeed")).isNotNull() if use_tags else F.lit(False)
    some = lambda c: F.sum(F.when(c, F.col("m")).otherwise(0.0))
    return x.groupBy("road").agg(F.sum("m").alias("metres"), some(tag).alias("tagged"), some(F.col("asked")).alias("asked"), some(F.col("asked") & F.col("urban")).alias("urban"))
