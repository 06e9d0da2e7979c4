"""Covariates, maps, codes, frames and invariants on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, parse
from ..operators import covariates, model, od, relational, reports, stats
from .base import query
from .flows import OD_SQL, TAU_SQL, matrix, times
from .prices import r6

PLACES_SQL = """p AS (SELECT lpad(CAST(c_custkey * 37 % 9999991 AS VARCHAR), 7, '0') AS code, c_acctbal::DOUBLE AS pop, c_custkey AS k FROM customer),
kd AS (SELECT *, substr(code, 1, 4) AS county, substr(code, 1, 2) AS region, CASE substr(code, 7, 1) WHEN '1' THEN 'urban' WHEN '3' THEN 'urban_rural' ELSE 'rural' END AS kind FROM p)"""


def _places(t):
    return t.customer.select(codes.code7(F.col("c_custkey") * 37 % 9999991).alias("code"), F.col("c_acctbal").cast("double").alias("pop"), F.col("c_custkey").alias("k"))


@query(f"""WITH {PLACES_SQL}, l AS (SELECT code, ln(k + 10) AS log_land FROM p WHERE k % 3 = 0), an AS (SELECT county, 1000.0::DOUBLE + min(k) AS anchor FROM kd GROUP BY county HAVING min(k) % 4 <> 0),
x AS (SELECT kd.*, log_land, anchor FROM kd LEFT JOIN l USING (code) LEFT JOIN an USING (county)),
f AS (SELECT *, coalesce(anchor, median(anchor) OVER (PARTITION BY region), (SELECT median(anchor) FROM x)) AS g, coalesce(log_land, median(log_land) OVER (PARTITION BY county), (SELECT median(log_land) FROM x)) AS ll FROM x)
SELECT code, county, round(ln(greatest(pop, 1)), 6) AS log_pop, kind, (kind = 'urban')::INT::DOUBLE AS urban, (kind = 'urban_rural')::INT::DOUBLE AS urban_rural, round(ll, 6) AS log_land, round(ln(g), 6) AS log_anchor FROM f""")
def place_covariates(t):
    p = _places(t)
    land = p.where("k % 3 = 0").select("code", F.ln(F.col("k") + 10).alias("log_land"))
    anchor = p.groupBy(F.substring("code", 1, 4).alias("county")).agg((F.min("k") + 1000.0).alias("anchor"), F.min("k").alias("k")).where("k % 4 <> 0")
    x = covariates.place_covariates(p, land, anchor)
    return x.select("code", "county", r6("log_pop").alias("log_pop"), "kind", "urban", "urban_rural", r6("log_land").alias("log_land"), r6("log_anchor").alias("log_anchor"))


@query(f"""WITH {PLACES_SQL}, a AS (SELECT kd.*, CASE WHEN k % 3 = 0 THEN pop END AS j0 FROM kd), b AS (SELECT *, coalesce(j0, median(j0) OVER (PARTITION BY county)) AS j1 FROM a),
c AS (SELECT *, coalesce(j1, median(j1) OVER (PARTITION BY region)) AS j2 FROM b), d AS (SELECT *, greatest(coalesce(j2, (SELECT median(j2) FROM c)), 1) AS jobs FROM c)
SELECT code, round(jobs, 4) AS jobs, round(ln(jobs), 6) AS log_jobs, (kind = 'urban')::INT::DOUBLE AS urban, (kind = 'urban_rural')::INT::DOUBLE AS urban_rural FROM d""")
def job_covariates(t):
    p = _places(t)
    x = covariates.job_covariates(p, p.where("k % 3 = 0").select("code", F.col("pop").alias("jobs")))
    return x.select("code", F.round("jobs", 4).alias("jobs"), r6("log_jobs").alias("log_jobs"), "urban", "urban_rural")


@query("""WITH a AS (SELECT CASE WHEN p_size > 25 THEN p_size * 1e6::DOUBLE END AS m2, lpad(CAST(p_partkey % 700 AS VARCHAR), 7, '0') AS code FROM part), b AS (SELECT code, min(m2) / 1e6 AS area_km2 FROM a GROUP BY code),
f AS (SELECT DISTINCT lpad(CAST(c_custkey % 900 AS VARCHAR), 7, '0') AS code FROM customer) SELECT code, area_km2 FROM f LEFT JOIN b USING (code)""")
def areas_attached(t):
    frame = t.customer.select(codes.code7(F.col("c_custkey") % 900).alias("code")).distinct()
    return covariates.with_area(frame, t.part.select((F.col("p_partkey") % 700).alias("Kod"), F.when(F.col("p_size") > 25, F.col("p_size") * 1e6).alias("m2")))


@query(f"""WITH {OD_SQL}, s AS (SELECT n, sum(CASE WHEN n = i THEN value ELSE 0 END)::DOUBLE / sum(value)::DOUBLE AS share, sum(value)::DOUBLE AS total FROM od GROUP BY n)
SELECT n, round(share, 9) AS share, round(ln(total), 6) AS log_total FROM s""")
def level_maps(t):
    m = matrix(t)
    total = reports.levels(m.groupBy("n").agg(F.sum("value").cast("double").alias("total")), "n", ["total"])
    return reports.own_share(m).join(total, "n").select("n", F.round(F.col("share").cast("double"), 9).alias("share"), r6("log_total").alias("log_total"))


YEARS_SQL = """a AS (SELECT o_custkey AS code, sum(o_totalprice)::DOUBLE AS v, count(*)::DOUBLE - 1 AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1), b AS (SELECT o_custkey AS code, sum(o_totalprice)::DOUBLE AS v, count(*)::DOUBLE - 1 AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)"""


def _year(t, year):
    return t.orders.where(F.year("o_orderdate") == year).groupBy(F.col("o_custkey").alias("code")).agg(F.sum("o_totalprice").cast("double").alias("v"), (F.count("*") - 1.0).alias("n"))


@query(f"WITH {YEARS_SQL} SELECT code, round(ln(b.v) - ln(a.v), 6) AS d_v, round(CASE WHEN a.n > 0 AND b.n > 0 THEN ln(b.n) - ln(a.n) END, 6) AS d_n FROM a JOIN b USING (code)")
def log_changes(t):
    return reports.log_changes(_year(t, 1995), _year(t, 1996), "code", ["v", "n"]).select("code", r6("d_v").alias("d_v"), r6("d_n").alias("d_n"))


@query(f"WITH {YEARS_SQL} SELECT count(*) AS pairs, round(corr(ln(a.v), ln(b.v)), 6) AS rho FROM a JOIN b USING (code) WHERE a.v > 0 AND b.v > 0")
def log_correlation(t):
    return reports.log_correlation(_year(t, 1995), _year(t, 1996), "code", "v").select("pairs", r6("rho").alias("rho"))


@query(f"WITH {TAU_SQL} SELECT i, tau AS a, CASE WHEN i % 4 <> 0 THEN tau * 0.9 + i END AS b, CASE WHEN i % 4 <> 0 THEN tau * 0.9 + i - tau END AS change FROM tau WHERE n = 7")
def times_from_origin(t):
    tau = od.effective_cost(times(t))
    later = tau.where("i % 4 <> 0").withColumn("tau", F.col("tau") * 0.9 + F.col("i"))
    return reports.from_origin(reports.aligned_runs(tau, later, ["n", "i"], "tau"), 7)


@query("""WITH d AS (SELECT c_custkey % 400 AS code, c_acctbal::DOUBLE AS v, c_nationkey AS g FROM customer), o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY v, g) AS k FROM d WHERE code % 7 <> 0),
f AS (SELECT DISTINCT p_partkey % 450 AS code FROM part) SELECT code, coalesce(v, -1) AS v, coalesce(g, 99)::INT AS g FROM f LEFT JOIN (SELECT * FROM o WHERE k = 1) USING (code)""")
def frame_aligned(t):
    d = t.customer.select((F.col("c_custkey") % 400).alias("code"), F.col("c_acctbal").cast("double").alias("v"), F.col("c_nationkey").alias("g")).where("code % 7 <> 0")
    x = relational.aligned(t.part.select((F.col("p_partkey") % 450).alias("code")).distinct(), d, "code", {"v": -1.0, "g": 99})
    return x.select("code", "v", F.col("g").cast("int").alias("g"))


@query("""WITH d AS (SELECT c_nationkey AS code, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal::DOUBLE END AS v, (c_custkey % 5)::DOUBLE AS w FROM customer), k AS (SELECT n_nationkey AS src, n_regionkey AS dst, 0.25::DOUBLE + n_nationkey / 50.0::DOUBLE AS weight FROM nation)
SELECT dst, round(sum(v * weight), 4) AS total, round(sum(CASE WHEN v IS NOT NULL AND w * weight > 0 THEN v * w * weight END) / sum(CASE WHEN v IS NOT NULL AND w * weight > 0 THEN w * weight END), 6) AS mean FROM d JOIN k ON code = src GROUP BY dst""")
def values_harmonised(t):
    d = t.customer.select(F.col("c_nationkey").alias("code"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal").cast("double")).alias("v"), (F.col("c_custkey") % 5).cast("double").alias("w"))
    walk = t.nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"), (0.25 + F.col("n_nationkey") / 50.0).alias("weight"))
    x = relational.harmonised(d, walk, "v").withColumnRenamed("v", "total").join(relational.harmonised(d, walk, "v", "mean", "w").withColumnRenamed("v", "mean"), "dst")
    return x.select("dst", F.round("total", 4).alias("total"), r6("mean").alias("mean"))


@query("""WITH m AS (SELECT year(o_orderdate) AS y, median(o_totalprice::DOUBLE) AS v FROM orders GROUP BY 1), k AS (SELECT max(CASE WHEN y = 1999 THEN v END) / max(CASE WHEN y = 1996 THEN v END) AS own, power(max(CASE WHEN y = 1998 THEN v END) / max(CASE WHEN y = 1995 THEN v END), 1 / 3.0::DOUBLE) AS rate FROM m)
SELECT round(own, 6) AS known, round(rate * rate, 6) AS compounded FROM k""")
def growth_factors(t):
    x = t.orders.select(F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("double").alias("v"))
    known, compounded = stats.growth_factor(x, "y", "v", 1996, 1999), stats.growth_factor(x.where("y <= 1998"), "y", "v", 1998, 2000)
    return t.spark.range(1).select(F.lit(round(known, 6)).alias("known"), F.lit(round(compounded, 6)).alias("compounded"))


@query(f"""WITH {OD_SQL}, {TAU_SQL}, l AS (SELECT i AS code, sum(value)::DOUBLE AS l FROM od GROUP BY i), r AS (SELECT n AS code, sum(value)::DOUBLE AS r FROM od GROUP BY n), z AS (SELECT sum(l) AS t FROM l),
s AS (SELECT code, l * 25 / t AS l, r * 25 / t AS r, code - 0.5::DOUBLE AS a, r / t AS u, exp((code - 12) / 10.0::DOUBLE) AS b FROM l JOIN r USING (code), z)
SELECT 'jobs' AS "check", abs(sum(l) - 25) < 1e-3 AS passed, round(sum(l), 6) AS value FROM s UNION ALL SELECT 'residents', abs(sum(r) - 25) < 1e-3, round(sum(r), 6) FROM s UNION ALL SELECT 'shares', abs(sum(u) - 1) < 1e-8, round(sum(u), 6) FROM s
UNION ALL SELECT 'productivity', min(a) > 0, round(min(a), 6) FROM s UNION ALL SELECT 'amenity', true, 1.0::DOUBLE
UNION ALL SELECT 'times', true, max(tau) FROM tau UNION ALL SELECT 'income', max(abs(l - r)) < 1e-3 * greatest(max(l), 1), round(max(abs(l - r)), 6) FROM s""")
def model_invariants(t):
    m = matrix(t).withColumn("value", F.col("value").cast("double"))
    total = F.broadcast(m.agg(F.sum("value").alias("t")))
    s = m.groupBy(F.col("i").alias("code")).agg(F.sum("value").alias("l")).join(m.groupBy(F.col("n").alias("code")).agg(F.sum("value").alias("r")), "code").crossJoin(total)
    s = s.select((F.col("l") * 25 / F.col("t")).alias("l"), (F.col("r") * 25 / F.col("t")).alias("r"), (F.col("code") - 0.5).alias("a"), (F.col("r") / F.col("t")).alias("uncond"), F.exp((F.col("code") - 12) / 10.0).alias("b"))
    x = model.invariants(s, 25.0, times(t), s.select(F.col("l").alias("income"), F.col("r").alias("expenditure")))
    return x.withColumn("value", r6("value"))


@query("""WITH x AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 13 % 9999991 AS VARCHAR), 7, '0') AS c, CASE o_custkey % 4 WHEN 0 THEN 'pierwotny' WHEN 1 THEN 'wtorny' WHEN 2 THEN 'inny' END AS m, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE substr(c, 7, 1) WHEN '1' THEN 'urban' WHEN '4' THEN 'urban' WHEN '2' THEN 'rural' WHEN '5' THEN 'rural' WHEN '3' THEN 'urban_rural' ELSE 'rural' END AS kind, substr(c, 5, 3) = '000' AND substr(c, 3, 2) <> '00' AS county,
substr(c, 5, 3) <> '000' AND substr(c, 3, 2) <> '00' AND substr(c, 7, 1) IN ('1', '2', '3') AS whole, lpad(CAST(o_orderkey AS VARCHAR), greatest(6, length(CAST(o_orderkey AS VARCHAR)))::INT, '0') AS six,
CASE m WHEN 'pierwotny' THEN 'primary' WHEN 'wtorny' THEN 'secondary' ELSE 'unknown' END AS market, CAST(year(d) AS INT) AS year, CAST(year(d) * 12 + month(d) - 1 AS INT) AS month FROM x""")
def codes_and_dates(t):
    c, day = codes.code7(F.col("o_orderkey") * 13 % 9999991), F.date_format("o_orderdate", "yyyy-MM-dd")
    market = F.when(F.col("o_custkey") % 4 == 0, "pierwotny").when(F.col("o_custkey") % 4 == 1, "wtorny").when(F.col("o_custkey") % 4 == 2, "inny")
    return t.orders.select("o_orderkey", codes.class_of(c, mixed=True).alias("kind"), codes.is_county(c).alias("county"), codes.is_whole_commune(c).alias("whole"), codes.whole6(F.col("o_orderkey")).alias("six"),
                           parse.market_category(market).alias("market"), parse.year_of(day).alias("year"), parse.month_index(parse.year_of(day), F.month("o_orderdate")).alias("month"))
