"""House and land transactions, comparisons, gates and roll-ups on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..operators import graph, reports, transactions
from .base import query
from .flows import OD_SQL, matrix
from .prices import r6

DEALS_SQL = """deals AS (SELECT l_orderkey, l_linenumber, l_partkey, s_nationkey AS county, CASE WHEN l_linestatus = 'F' THEN 'built' ELSE 'undeveloped' END AS kind, l_linenumber % 2 AS residential,
  CASE l_returnflag WHEN 'A' THEN 'overlap' WHEN 'R' THEN 'nearest' END AS match, l_quantity::DOUBLE AS footprint, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity::DOUBLE * 3 END AS usable,
  CASE WHEN l_tax < 0.06 THEN 'free' ELSE 'other' END AS deal, CASE WHEN l_discount < 0.05 THEN '1/1' WHEN l_discount > 0.08 THEN '1/2' END AS share, l_linenumber AS floors, l_discount::DOUBLE * 10 AS overlap,
  l_extendedprice::DOUBLE AS price, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity::DOUBLE * 0.7 END AS plot, CAST(year(l_shipdate) AS INT) AS year FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def deals(t):
    d = lambda c: F.col(c).cast("double")
    x = t.lineitem.join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("county")), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey", "county", F.when(F.col("l_linestatus") == "F", "built").otherwise("undeveloped").alias("kind"), (F.col("l_linenumber") % 2).alias("residential"),
        F.when(F.col("l_returnflag") == "A", "overlap").when(F.col("l_returnflag") == "R", "nearest").alias("match"), d("l_quantity").alias("footprint"), F.when(F.col("l_partkey") % 7 != 0, d("l_quantity") * 3).alias("usable"),
        F.when(F.col("l_tax") < 0.06, "free").otherwise("other").alias("deal"), F.when(F.col("l_discount") < 0.05, "1/1").when(F.col("l_discount") > 0.08, "1/2").alias("share"), F.col("l_linenumber").alias("floors"), (d("l_discount") * 10).alias("overlap"),
        d("l_extendedprice").alias("price"), F.when(F.col("l_partkey") % 3 != 0, d("l_quantity") * 0.7).alias("plot"), F.year("l_shipdate").alias("year"))


HOUSES_SQL = """h AS (SELECT * FROM deals WHERE kind = 'built' AND residential = 1 AND (match = 'overlap' OR match = 'nearest' AND footprint >= 40) AND usable IS NOT NULL AND deal = 'free'
  AND (share = '1/1' OR share IS NULL) AND floors BETWEEN 1 AND 5 AND (overlap >= 0.30 OR match = 'nearest'))"""


@query(f"WITH {DEALS_SQL}, {HOUSES_SQL} SELECT l_orderkey, l_linenumber, l_partkey FROM h")
def houses_filtered(t):
    return transactions.house_filter(deals(t), nearest=True).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"""WITH {DEALS_SQL}, {HOUSES_SQL}, p AS (SELECT *, CASE WHEN plot > 0 THEN plot ELSE median(plot) OVER (PARTITION BY county) END AS u, CASE WHEN county % 5 <> 0 THEN 50.0::DOUBLE + county END AS land FROM h),
n AS (SELECT *, (price - least(coalesce(land * u, 0), 0.6 * price)) / usable AS ppm2 FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, round(u, 6) AS plot_used, round(ppm2, 6) AS ppm2 FROM n WHERE usable BETWEEN 25 AND 1000 AND ppm2 BETWEEN 250 AND 600 AND year BETWEEN 1993 AND 1997""")
def houses_netted(t):
    x = transactions.house_filter(deals(t), nearest=True).withColumn("area", F.col("usable"))
    x = transactions.land_netted(x.withColumn("land_ppm2", F.when(F.col("county") % 5 != 0, 50.0 + F.col("county"))), "county")
    return transactions.house_gates(x, (1993, 1997), ppm2=(250.0, 600.0)).select("l_orderkey", "l_linenumber", "l_partkey", r6("plot_used").alias("plot_used"), r6("ppm2").alias("ppm2"))


@query(f"""WITH {DEALS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 11 = 0 THEN 1.0::DOUBLE WHEN l_partkey % 13 = 0 THEN 0.7::DOUBLE WHEN match = 'nearest' THEN 0.5::DOUBLE ELSE least(greatest(coalesce(overlap, 0.7), 0.5), 1.0) END AS weight,
round(CASE WHEN plot > 0 AND plot < footprint THEN plot * 10000 ELSE plot END, 4) AS plot FROM deals WHERE NOT coalesce(share IN ('1/2'), false)""")
def house_weights(t):
    x = transactions.private_sellers(deals(t), "share", ["1/2"])
    source = F.when(F.col("l_partkey") % 11 == 0, "flat").when(F.col("l_partkey") % 13 == 0, "marginal").otherwise("primary")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", transactions.quality_weight(source, F.col("overlap"), F.col("match")).alias("weight"), F.round(transactions.plot_in_metres(F.col("plot"), F.col("footprint")), 4).alias("plot"))


@query(f"""WITH {DEALS_SQL}, l AS (SELECT *, CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE price END AS a, price / 2 AS b, CASE WHEN l_partkey % 10 = 0 THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END * footprint AS rec FROM deals
  WHERE kind = 'undeveloped' AND deal = 'free' AND (share = '1/1' OR share IS NULL) AND (match IS NULL OR l_linenumber % 2 = 0)),
p AS (SELECT *, CASE WHEN a > 0 THEN a ELSE b END AS lp FROM l WHERE county % 9 <> 0), q AS (SELECT *, lp / footprint AS ppm2, rec / footprint < 0.02 AS ha FROM p WHERE lp > 0 AND footprint > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, price) AS k FROM q WHERE ppm2 BETWEEN 1 AND 1500 AND year BETWEEN 1995 AND 1998)
SELECT l_orderkey, l_linenumber, round(ppm2, 6) AS land_ppm2, ha AS ha_flag FROM k WHERE k = 1""")
def land_priced(t):
    x = deals(t).withColumn("zoning", F.when(F.col("match").isNull(), "x budownictwoMieszkaniowe")).withColumn("use", F.when(F.col("l_linenumber") % 2 == 0, "gruntyZabudowaneIZurbanizowane"))
    x = transactions.land_filter(x).select(
        "l_orderkey", "l_linenumber", "l_partkey", "price", F.when(F.col("l_partkey") % 4 != 0, F.col("price")).otherwise(0.0).alias("price_whole"), (F.col("price") / 2).alias("price_part"), F.col("footprint").alias("area"),
        (F.when(F.col("l_partkey") % 10 == 0, 0.01).otherwise(1.0) * F.col("footprint")).alias("recorded"), F.when(F.col("county") % 9 != 0, 1.0).alias("x"), "year")
    return transactions.land_prices(x, "l_orderkey", ["l_linenumber", "l_partkey", "price"], (1995, 1998), (1.0, 1500.0)).select("l_orderkey", "l_linenumber", r6("land_ppm2").alias("land_ppm2"), "ha_flag")


@query("""WITH a AS (SELECT l_orderkey, sum(l_quantity)::DOUBLE AS usable, max(l_linenumber) AS floors FROM lineitem GROUP BY 1),
f AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber DESC, l_partkey DESC) AS k FROM lineitem)
SELECT l_orderkey, l_partkey, usable, floors FROM a JOIN f USING (l_orderkey) WHERE k = 1""")
def largest_parts(t):
    return transactions.largest_first(t.lineitem, "l_orderkey", "l_extendedprice", ["l_linenumber", "l_partkey"], ["l_partkey"], {"usable": F.sum("l_quantity").cast("double"), "floors": F.max("l_linenumber")})


@query("""WITH b AS (SELECT p_partkey AS l_partkey, sum(p_size * 10) AS usable, max(p_size % 7) AS floors, count(*) AS buildings FROM part WHERE p_size % 2 = 1 AND p_size % 7 BETWEEN 1 AND 5 GROUP BY 1),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, usable, floors, row_number() OVER (PARTITION BY l_orderkey ORDER BY usable DESC, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem JOIN b USING (l_partkey)
  WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'))
SELECT l_orderkey, l_linenumber, l_partkey, CAST(usable AS BIGINT) AS usable FROM x WHERE k = 1""")
def houses_marginal(t):
    b = transactions.bridge(t.part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 2).alias("residential"), (F.col("p_size") * 10).alias("usable"), (F.col("p_size") % 7).alias("floors")), "l_partkey")
    x = transactions.marginal_houses(t.lineitem, t.lineitem.where("l_returnflag = 'A'"), b, "l_orderkey", "l_partkey", ["l_linenumber", "l_partkey", "l_extendedprice"])
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.col("usable").cast("long").alias("usable"))


def _yearly(t, year):
    return t.orders.where(F.year("o_orderdate") == year).groupBy(F.col("o_custkey").alias("code")).agg(F.sum("o_totalprice").cast("double").alias("v"))


YEARLY_SQL = """a AS (SELECT o_custkey AS code, sum(o_totalprice)::DOUBLE AS v FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1), b AS (SELECT o_custkey AS code, sum(o_totalprice)::DOUBLE AS v FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)"""


@query(f"""WITH {YEARLY_SQL}, d AS (SELECT b.v - a.v AS d FROM a JOIN b USING (code))
SELECT count(*) AS pairs, round(avg(d), 4) AS mean, round(median(d), 4) AS median, round(min(d), 4) AS least, round(max(d), 4) AS most, round(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END), 6) AS fell FROM d""")
def runs_compared(t):
    x = reports.difference(reports.aligned_runs(_yearly(t, 1995), _yearly(t, 1996), ["code"], "v"))
    return x.select("pairs", *[F.round(c, 4).alias(c) for c in ("mean", "median", "least", "most")], r6("fell").alias("fell"))


@query(f"WITH {YEARLY_SQL} SELECT code, round(b.v / a.v - 1, 6) AS growth, round(ln(b.v / a.v), 6) AS log_change FROM a JOIN b USING (code) WHERE a.v > 0 AND b.v > 0")
def value_growth(t):
    return reports.growth(_yearly(t, 1996), _yearly(t, 1995), "code", "v").select("code", r6("growth").alias("growth"), r6("log_change").alias("log_change"))


@query("""WITH c AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS code, c_acctbal::DOUBLE AS bal, c_nationkey + 1.0::DOUBLE AS w, 1 AS n FROM customer)
SELECT substr(code, 1, 4) AS code, CAST(sum(n) AS BIGINT) AS n, round(sum(bal * w) / sum(w), 6) AS bal FROM c GROUP BY 1""")
def codes_rolled_up(t):
    x = t.customer.select(codes.code7(F.col("c_custkey")).alias("code"), F.col("c_acctbal").cast("double").alias("bal"), (F.col("c_nationkey") + 1.0).alias("w"), F.lit(1).alias("n"))
    return reports.rolled_up(x, "code", 4, ["n"], "bal", "w").select("code", "n", r6("bal").alias("bal"))


@query("SELECT o_orderpriority, count(o_totalprice) AS n, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY 1")
def value_boxes(t):
    return reports.boxes(t.orders, "o_orderpriority", "o_totalprice").select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")])


@query("SELECT coalesce(lang, '(missing)') AS lang, count(*) AS n FROM documents GROUP BY 1")
def rows_inventory(t):
    return reports.inventory(t.documents, "lang")


@query("SELECT DISTINCT source FROM documents")
def partition_keys(t):
    return reports.parts_of(t.documents, "source")


@query("SELECT l_returnflag AS road, sum(l_quantity)::DOUBLE AS total, round(sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END)::DOUBLE / sum(l_quantity), 6) AS tagged_share FROM lineitem GROUP BY 1")
def class_totals(t):
    x = t.lineitem.select(F.col("l_returnflag").alias("road"), F.col("l_quantity").cast("double").alias("m"), (F.col("l_discount") > 0.05).alias("tagged"))
    return reports.class_totals(x, "road", "m", "tagged").select("road", "total", r6("tagged_share").alias("tagged_share"))


@query("""WITH p AS (SELECT c_custkey, c_acctbal::DOUBLE AS x, c_custkey % 1000 + 0.0::DOUBLE AS y FROM customer)
SELECT c_custkey, round(sqrt((x - 3000) * (x - 3000) + (y - 500) * (y - 500)), 6) AS distance FROM p WHERE sqrt((x - 3000) * (x - 3000) + (y - 500) * (y - 500)) <= 400""")
def points_within(t):
    p = t.customer.select("c_custkey", F.col("c_acctbal").cast("double").alias("x"), (F.col("c_custkey") % 1000 + 0.0).alias("y"))
    return reports.within_radius(p, 3000.0, 500.0, 400.0).select("c_custkey", r6("distance").alias("distance"))


@query("SELECT round(avg(CASE WHEN c_nationkey = c_custkey % 25 THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM customer WHERE c_nationkey IS NOT NULL AND c_custkey % 25 <> 7")
def codes_agree(t):
    x = t.customer.withColumn("k", F.when(F.col("c_custkey") % 25 != 7, F.col("c_custkey") % 25))
    return reports.agreement(x, "c_nationkey", "k").select(r6("rate").alias("rate"), "n")


@query("""WITH f AS (SELECT n_nationkey AS code FROM nation), d AS (SELECT s_nationkey AS code, avg(s_acctbal)::DOUBLE + 5000 AS w, count(*)::DOUBLE AS e FROM supplier GROUP BY 1),
m AS (SELECT n_regionkey AS g, sum(w * e) / sum(e) AS m FROM d JOIN nation ON code = n_nationkey GROUP BY 1)
SELECT 'unique' AS "check", true AS passed, 0.0::DOUBLE AS value UNION ALL
SELECT 'complete', count(*) = 0, count(*)::DOUBLE FROM f WHERE code NOT IN (SELECT code FROM d) UNION ALL
SELECT 'known', true, 0.0::DOUBLE UNION ALL
SELECT 'anchored', max(abs(m / round(m, 2) - 1)) <= 1e-6, round(max(abs(m / round(m, 2) - 1)), 9) FROM m""")
def labour_gates(t):
    d = t.supplier.groupBy(F.col("s_nationkey").alias("code")).agg((F.avg("s_acctbal") + 5000).alias("w"), F.count("*").cast("double").alias("e"))
    d = d.join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("g"))), "code")
    anchor = d.groupBy("g").agg(F.round(F.sum(F.col("w") * F.col("e")) / F.sum("e"), 2).alias("anchor"))
    return reports.frame_gates(d, t.nation.select(F.col("n_nationkey").alias("code")), "code", "w", "e", "g", anchor).withColumn("value", F.round("value", 9))


@query("""WITH s AS (SELECT n_nationkey AS code, CASE WHEN n_nationkey = 24 THEN 0.99::DOUBLE ELSE 0.8::DOUBLE + n_nationkey / 100.0::DOUBLE END AS scc, 0.4::DOUBLE + n_nationkey / 40.0::DOUBLE AS cov, n_nationkey * 300.0::DOUBLE AS far, n_nationkey % 3 AS un, 100.0::DOUBLE + n_nationkey * 10 AS km, CASE WHEN n_nationkey % 2 = 0 THEN 300.0::DOUBLE END AS bench FROM nation),
v AS (SELECT code, greatest(CASE WHEN scc < 0.85 THEN 2 WHEN scc < 0.98 THEN 1 ELSE 0 END, CASE WHEN cov < 0.5 THEN 2 WHEN cov < 0.8 THEN 1 ELSE 0 END, CASE WHEN far > 5000 THEN 1 ELSE 0 END, CASE WHEN km / bench < 0.75 THEN 2 WHEN km / bench < 0.9 THEN 1 ELSE 0 END, CASE WHEN un > 0 THEN 1 ELSE 0 END) AS l FROM s)
SELECT code, ['GOOD', 'USABLE-WITH-CAVEATS', 'BAD'][l + 1] AS verdict FROM v""")
def network_verdicts(t):
    n = F.col("n_nationkey")
    x = t.nation.select(n.alias("code"), F.when(n == 24, 0.99).otherwise(0.8 + n / 100.0).alias("scc_share"), (0.4 + n / 40.0).alias("coverage"), (n * 300.0).alias("farthest_snap"), (n % 3).alias("unreachable"), (100.0 + n * 10).alias("km"), F.when(n % 2 == 0, 300.0).alias("benchmark_km"))
    return graph.verdict(x).select("code", "verdict")


@query("""WITH x AS (SELECT p_partkey, p_size, lower(p_type) AS f FROM part)
SELECT p_partkey, contains(f, 'mieszk') OR p_size % 5 = 0 AS residential, CASE WHEN p_size % 4 <> 0 THEN p_size * 2.5::DOUBLE * (p_size % 4) * 0.8::DOUBLE ELSE 0 END AS usable FROM x""")
def building_areas(t):
    kind = F.when(F.col("p_size") % 5 == 0, "Mieszkalny")
    return t.part.select("p_partkey", transactions.residential(F.col("p_type"), kind).alias("residential"), transactions.floor_area(F.col("p_size") * 2.5, F.col("p_size") % 4, 0.8).alias("usable"))


@query(f"""WITH {OD_SQL}, r AS (SELECT n, sum(value) AS r FROM od GROUP BY n), l AS (SELECT i, sum(value) AS l FROM od GROUP BY i),
g AS (SELECT i, sum(value / r * r * (1 + od.n / 50.0::DOUBLE)) AS e FROM od JOIN r USING (n) GROUP BY i)
SELECT i AS code, round(l * (1 + i / 100.0::DOUBLE), 6) AS income, round(e, 6) AS expenditure, round(abs(l * (1 + i / 100.0::DOUBLE) - e), 6) AS gap FROM l JOIN g USING (i)""")
def income_balance(t):
    """What places earn against what is spent on their goods, under the weights of the flows."""
    m = matrix(t).select("n", "i", F.col("value").alias("x"))
    p = m.groupBy(F.col("i").alias("code")).agg(F.sum("x").alias("l")).join(m.groupBy(F.col("n").alias("code")).agg(F.sum("x").alias("r")), "code")
    p = p.withColumn("w", 1.0 + F.col("code") / 100.0).withColumn("v", 1.0 + F.col("code") / 50.0)
    return reports.balance(m, p).select("code", *[r6(c).alias(c) for c in ("income", "expenditure", "gap")])
