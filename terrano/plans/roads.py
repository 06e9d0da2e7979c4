"""Road networks on the driver's tables: an order is a way, its line items the vertices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import roads
from .base import query
from .prices import r6

CLASSES = ["motorway", "primary", "tertiary", "residential", "service", "unclassified", "secondary"]
#: Middle vertices are placed by scaled degrees, so that the SQL can do the same.
SCALE = (70_000.0, 111_000.0)

VERTICES_SQL = """vx AS (SELECT l_orderkey AS way, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey AS ref, 14 + (l_partkey % 997) / 100.0::DOUBLE AS lon, 49 + (l_partkey % 389) / 70.0::DOUBLE AS lat FROM lineitem),
w AS (SELECT o_orderkey AS way, o_custkey AS c, ['motorway', 'primary', 'tertiary', 'residential', 'service', 'unclassified', 'secondary'][1 + o_custkey % 7] AS road,
  CASE o_custkey % 5 WHEN 0 THEN 110 WHEN 1 THEN 70 WHEN 2 THEN 50 END::DOUBLE AS tag, CASE o_custkey % 11 WHEN 3 THEN 'yes' WHEN 4 THEN '-1' WHEN 5 THEN 'no' END AS ow, CASE o_custkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 1 END AS lanes,
  CASE o_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS zone, (SELECT count(*) FROM vx WHERE vx.way = o_orderkey) AS n FROM orders),
sp AS (SELECT * FROM (VALUES ('motorway', 140, 140, 2000), ('primary', 85, 60, 1400), ('tertiary', 90, 50, 900), ('residential', 50, 40, 600), ('service', 30, 30, 300), ('unclassified', 70, 50, 600), ('secondary', 90, 50, 1200)) AS t(road, rural, urban_kmh, per)),
cl AS (SELECT p_partkey AS rid, (14 + (p_partkey % 91) / 9.0::DOUBLE) * 70000 AS x, (49 + (p_partkey % 47) / 8.3::DOUBLE) * 111000 AS y FROM part WHERE p_size > 35),
a AS (SELECT w.*, rural, urban_kmh, per, rural <> urban_kmh AND tag IS NULL AS asked FROM w JOIN sp USING (road) WHERE n >= 2),
md AS (SELECT a.way, lon * 70000 AS x, lat * 111000 AS y FROM a JOIN vx ON a.way = vx.way AND vx.pos = n // 2 WHERE asked AND zone IS NULL),
hit AS (SELECT DISTINCT way FROM md JOIN (SELECT DISTINCT x, y FROM cl) c ON sqrt((md.x - c.x) * (md.x - c.x) + (md.y - c.y) * (md.y - c.y)) <= 9000.5),
b AS (SELECT a.*, CASE WHEN asked AND zone IS NULL THEN way IN (SELECT way FROM hit) WHEN asked THEN zone ELSE road IN ('residential', 'service') END AS urban FROM a),
sg AS (SELECT way, ref AS u, lon, lat, lead(ref) OVER s AS v, lead(lon) OVER s AS lon2, lead(lat) OVER s AS lat2 FROM vx WINDOW s AS (PARTITION BY way ORDER BY pos)),
k AS (SELECT *, 1 - 0.0066943799901413165::DOUBLE * power(sin(radians((lat + lat2) / 2)), 2) AS q FROM sg WHERE v IS NOT NULL),
m AS (SELECT way, u, v, sqrt(power(6378137.0::DOUBLE * (1 - 0.0066943799901413165::DOUBLE) / (q * sqrt(q)) * radians(lat2 - lat), 2) + power(6378137.0::DOUBLE / sqrt(q) * cos(radians((lat + lat2) / 2)) * radians(lon2 - lon), 2)) AS len FROM k)"""


def _ways(t):
    v = t.lineitem.groupBy(F.col("l_orderkey").alias("way")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("p"))
    place = lambda base, m, d: F.transform("p", lambda s: base + s["l_partkey"] % m / d)
    c = F.col("o_custkey")
    x = t.orders.join(v, F.col("o_orderkey") == F.col("way"))
    return x.select(
        "way", F.col("p.l_partkey").alias("refs"), place(14, 997, 100.0).alias("lons"), place(49, 389, 70.0).alias("lats"), F.get(F.array(*[F.lit(k) for k in CLASSES]), (c % 7).cast("int")).alias("highway"),
        F.when(c % 5 == 0, "110").when(c % 5 == 1, "90; 70").when(c % 5 == 2, "PL:urban").alias("maxspeed"), F.when(c % 11 == 3, "Yes").when(c % 11 == 4, "-1").when(c % 11 == 5, "no").alias("oneway"), F.lit(None).cast("string").alias("junction"),
        F.when(c % 6 == 0, "3;2").when(c % 6 == 1, "0.5").alias("lanes"), F.when(c % 4 == 0, "PL:urban").when(c % 4 == 1, "PL:rural").alias("zone_traffic"), F.lit("").alias("source_maxspeed"), F.lit(None).cast("string").alias("zone_maxspeed"), F.lit(None).cast("string").alias("maxspeed_type"),
        F.lit(None).cast("string").alias("motor_vehicle"), F.lit("").alias("motorcar"), F.lit("yes").alias("access"))


def _settled(t):
    p = F.col("p_partkey")
    cells = t.part.where("p_size > 35").select(p.alias("rid"), ((14 + p % 91 / 9.0) * SCALE[0]).alias("x"), ((49 + p % 47 / 8.3) * SCALE[1]).alias("y")).dropDuplicates(["x", "y"])
    speeds = roads.profile({"primary": (85, 60)})
    return roads.built_up(roads.drivable(_ways(t)), speeds, cells=cells, cell_size=9000.5, metric=lambda lon, lat: (lon * SCALE[0], lat * SCALE[1])), speeds


@query(f"""WITH {VERTICES_SQL}, e AS (SELECT b.*, u, v, len, coalesce(tag, (CASE WHEN urban THEN urban_kmh ELSE rural END) * 0.9) AS kmh, coalesce(ow = 'no', false) AS two, coalesce(ow = '-1', false) AS rev, coalesce(ow = 'yes', false) OR road = 'motorway' AS fw FROM b JOIN m USING (way) WHERE len > 0 AND u <> v),
d AS (SELECT *, two OR NOT rev AS f, two OR rev OR NOT fw AS r FROM e), g AS (SELECT *, per * coalesce(lanes, CASE WHEN r THEN 2 ELSE 1 END) AS cap FROM d)
SELECT way, u, v, round(len, 4) AS len, round(len / (kmh / 3.6), 4) AS time, cap::DOUBLE AS cap FROM g WHERE f UNION ALL SELECT way, v, u, round(len, 4), round(len / (kmh / 3.6), 4), cap::DOUBLE FROM g WHERE r""")
def road_edges(t):
    x, speeds = _settled(t)
    return roads.edges(x, speeds, 0.9).select("way", "u", "v", F.round("len", 4).alias("len"), F.round("time", 4).alias("time"), "cap")


@query(f"""WITH {VERTICES_SQL}, l AS (SELECT way, sum(len) AS len FROM m GROUP BY way)
SELECT road, round(sum(len) / 1000, 3) AS metres, round(sum(CASE WHEN tag IS NOT NULL THEN len ELSE 0 END) / sum(len), 6) AS tagged, round(sum(CASE WHEN asked THEN len ELSE 0 END) / sum(len), 6) AS asked,
round(sum(CASE WHEN asked AND urban THEN len ELSE 0 END) / sum(len), 6) AS urban FROM b JOIN l USING (way) GROUP BY road""")
def road_coverage(t):
    x = roads.coverage(_settled(t)[0])
    return x.select("road", F.round(F.col("metres") / 1000, 3).alias("metres"), *[r6(F.col(c) / F.col("metres")).alias(c) for c in ("tagged", "asked", "urban")])
