"""Projections, speed rules, calibration, crosswalks, tilings and class breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse, projection
from ..operators import relational, spatial, stats
from .base import query
from .space import P_SQL, _points


@query("SELECT vec_id AS pid, round(14 + (vec_id % 100) / 10.0, 6)::DOUBLE AS lon, round(49 + (vec_id % 60) / 10.0, 6)::DOUBLE AS lat, true AS laea_ok, true AS tm_ok FROM embeddings")
def projections_round_trip(t):
    """Degrees to both grids and back: the SQL has what must come out."""
    x = t.embeddings.select(F.col("vec_id").alias("pid"), (14 + F.col("vec_id") % 100 / 10).alias("lon"), (49 + F.col("vec_id") % 60 / 10).alias("lat"))
    lon, lat = F.col("lon"), F.col("lat")

    def ok(there, back):
        a, b = back(*there(lon, lat))
        return (F.abs(a - lon) < 1e-8) & (F.abs(b - lat) < 1e-8)
    return x.select("pid", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), ok(projection.to_laea, projection.from_laea).alias("laea_ok"), ok(projection.to_tm, projection.from_tm).alias("tm_ok"))


@query("""WITH w AS (SELECT c_mktsegment AS road, c_nationkey % 2 = 0 AS urban, c_acctbal AS metres, c_custkey % 90 + 20 AS kmh FROM customer WHERE c_acctbal > 0 AND c_custkey % 3 > 0),
s AS (SELECT road, urban, kmh, sum(metres) AS s FROM w GROUP BY road, urban, kmh),
o AS (SELECT road, urban, kmh, sum(s) OVER (PARTITION BY road, urban ORDER BY kmh) AS c, sum(s) OVER (PARTITION BY road, urban) AS t FROM s),
m AS (SELECT road, urban, min(kmh) AS v FROM o WHERE c >= t / 2 AND t >= 450000 GROUP BY road, urban),
d AS (SELECT DISTINCT c_mktsegment AS road, c_nationkey % 2 = 0 AS urban FROM customer)
SELECT d.road, d.urban, coalesce(round_even(v / 5.0, 0) * 5, 50)::DOUBLE AS kmh, v IS NOT NULL AS measured FROM d LEFT JOIN m ON d.road = m.road AND d.urban = m.urban""")
def speed_rules(t):
    c = t.customer.select(F.col("c_mktsegment").alias("road"), (F.col("c_nationkey") % 2 == 0).alias("urban"), F.col("c_acctbal").alias("metres"), (F.col("c_custkey") % 90 + 20).alias("kmh"), "c_custkey")
    ways = c.where("metres > 0").withColumn("kmh", F.when(F.col("c_custkey") % 3 > 0, F.col("kmh")))
    defaults = c.select("road", "urban").distinct().withColumn("kmh", F.lit(50.0))
    return stats.speed_profile(ways, defaults, 450_000.0)


@query("""WITH x AS (SELECT p_brand, l_extendedprice / (l_quantity * p_retailprice) * (0.4 + l_linenumber * 0.1) AS r FROM lineitem JOIN part ON l_partkey = p_partkey),
o AS (SELECT * FROM x WHERE r > 0.3 AND r < 1.2), g AS (SELECT p_brand, count(*) AS n, median(r) AS m FROM o GROUP BY p_brand)
SELECT b.p_brand, coalesce(n, 0)::BIGINT AS n, round(CASE WHEN n >= 100 THEN m ELSE (SELECT median(r) FROM o) END, 6) AS k FROM (SELECT DISTINCT p_brand FROM x) b LEFT JOIN g USING (p_brand)""")
def calibration_factors(t):
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", (F.col("l_extendedprice") / (F.col("l_quantity") * F.col("p_retailprice")) * (0.4 + F.col("l_linenumber") * 0.1)).alias("r"))
    return stats.calibration_factor(x, "p_brand", "r").select("p_brand", "n", F.round("k", 6).alias("k"))


@query("""WITH g AS (SELECT n_regionkey AS k, 1 + n_regionkey / 10.0 AS growth FROM nation WHERE n_regionkey <> 2 GROUP BY ALL)
SELECT n_nationkey, round(n_nationkey * 100 * coalesce(growth, (SELECT median(growth) FROM g)), 6)::DOUBLE AS value FROM nation LEFT JOIN g ON k = n_regionkey""")
def anchors_extrapolated(t):
    anchor = t.nation.select("n_nationkey", F.col("n_regionkey").alias("k"), (F.col("n_nationkey") * 100).cast("double").alias("value"))
    growth = t.nation.where("n_regionkey != 2").select(F.col("n_regionkey").alias("k"), (1 + F.col("n_regionkey") / 10).alias("growth")).distinct()
    return stats.extrapolated(anchor, growth, "k", ["value"]).select("n_nationkey", F.round("value", 6).alias("value"))


@query("""SELECT n_nationkey::VARCHAR AS src, CASE WHEN n_nationkey = 3 THEN d ELSE n_nationkey::VARCHAR END AS dst, CASE WHEN n_nationkey <> 3 THEN 1.0 WHEN d = '4' THEN 0.72 ELSE 0.28 END::DOUBLE AS weight
FROM nation JOIN (VALUES ('4'), ('5')) v(d) ON n_nationkey = 3 OR d = '4'""")
def crosswalk_built(t):
    codes = t.nation.select(F.col("n_nationkey").cast("string").alias("src"))
    specials = t.spark.createDataFrame([("3", "4", 1.44), ("3", "5", 0.56)], "src string, dst string, weight double")
    x = relational.crosswalk(codes, codes.where("src != '3'").withColumnRenamed("src", "dst"), specials)
    return x.withColumn("weight", F.round("weight", 6))


@query("""WITH r AS (SELECT c_nationkey, c_custkey, greatest(c_acctbal, 0) AS w, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer)
SELECT c_nationkey, c_custkey, rank::INT AS rank, round(w / sum(w) OVER (PARTITION BY c_nationkey), 6) AS share FROM r WHERE rank <= 5""")
def candidate_shares(t):
    x = t.customer.select("c_nationkey", "c_custkey", "c_acctbal", F.greatest("c_acctbal", F.lit(0.0)).alias("w"))
    return relational.top_shares(x, "c_nationkey", [F.desc("c_acctbal"), F.asc("c_custkey")], "w", 5).select("c_nationkey", "c_custkey", "rank", F.round("share", 6).alias("share"))


@query(f"""WITH {P_SQL}, c AS (SELECT least(floor((x + 64) / 8), 15)::BIGINT AS cx, least(floor((y + 64) / 8), 15)::BIGINT AS cy FROM p WHERE x BETWEEN -64 AND 64 AND y BETWEEN -64 AND 64),
t AS (SELECT l, cx >> (4 - l) AS tx, cy >> (4 - l) AS ty, count(*) AS n FROM c, (SELECT unnest(range(5)) AS l) GROUP BY 1, 2, 3)
SELECT t.l || '_' || t.tx || '_' || t.ty AS tile, -64 + t.tx * 128 / pow(2, t.l) AS x0, -64 + t.ty * 128 / pow(2, t.l) AS y0, t.n
FROM t LEFT JOIN t u ON u.l = t.l - 1 AND u.tx = t.tx >> 1 AND u.ty = t.ty >> 1 WHERE (t.n <= 20 OR t.l = 4) AND (u.n IS NULL OR u.n > 20)""")
def quadtree_leaves(t):
    return spatial.quadtree(_points(t), (-64.0, -64.0, 64.0, 64.0), most=20, depth=4, side=1.0).select("tile", "x0", "y0", "n")


@query(f"""WITH {P_SQL}, c AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY pid) AS k, printf('%.1f %.1f', x, y) AS s FROM p)
SELECT label, count(*) AS n, 'MULTIPOINT (' || string_agg('(' || s || ')', ', ' ORDER BY k) || ')' AS wkt FROM c WHERE k <= 3 GROUP BY label""")
def candidates_wkt(t):
    x = relational.top_shares(_points(t), "label", [F.asc("pid")], "pid", 3).withColumnRenamed("rank", "cand_rank")
    return spatial.candidate_wkt(x, "label")


@query()
def natural_breaks(t):
    """Class breaks of account balances; no SQL: tested against all partitions of a small table."""
    return stats.natural_breaks(t.customer, "c_acctbal", 7)


@query("SELECT -max(abs(c_acctbal)) AS lo, max(abs(c_acctbal)) AS hi FROM customer")
def diverging_limits(t):
    return stats.diverging_limits(t.customer, "c_acctbal")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'motorway' WHEN o_orderkey % 4 = 1 THEN 'trunk' WHEN o_orderkey % 4 = 2 THEN 'primary' END AS road,
CASE WHEN o_orderkey % 4 = 0 THEN 140.0 WHEN o_orderkey % 4 = 1 THEN 120.0 ELSE 100.0 END::DOUBLE AS kmh, o_orderkey AS matched FROM orders""")
def map_roads(t):
    k = F.col("o_orderkey") % 4
    label = F.when(k == 0, F.lit(" A2")).when(k == 1, F.lit("S17")).otherwise(F.lit("DK 7"))
    cls = F.when(k == 3, F.lit("cycleway")).otherwise(F.lit("trunk"))
    reply = F.format_string('<wfs numberMatched="%d" numberReturned="0">', "o_orderkey")
    return t.orders.select("o_orderkey", parse.map_class(cls, label).alias("road"), parse.numbered_speed(F.lit(100), label).alias("kmh"), parse.reply_count(reply, "numberMatched").alias("matched"))
