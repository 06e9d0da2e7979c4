"""Transaction cleaning, price indices, codes and parsing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codes, parse
from ..operators import hedonic, relational, stats, transactions
from .base import Tables, query

MICRO_SQL = """micro AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity AS ppm2, l_quantity AS area, l_returnflag AS market, p_type AS kind, p_size AS rooms,
    CAST(year(l_shipdate) AS INT) AS year, s_nationkey AS area_code, n_regionkey AS region, l_extendedprice AS price, l_discount + 0.0 AS l_discount
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def micro(t: Tables) -> DataFrame:
    """Transactions with price per unit, kind, market, year and area."""
    x = t.lineitem.join(t.part.select("p_partkey", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    s = t.supplier.select("s_suppkey", "s_nationkey").join(F.broadcast(t.nation.select("n_nationkey", "n_regionkey")), F.col("s_nationkey") == F.col("n_nationkey"))
    x = x.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("ppm2"), F.col("l_quantity").alias("area"), F.col("l_returnflag").alias("market"), F.col("p_type").alias("kind"), F.col("p_size").alias("rooms"), F.year("l_shipdate").alias("year"), F.col("s_nationkey").alias("area_code"), F.col("n_regionkey").alias("region"), F.col("l_extendedprice").alias("price"), (F.col("l_discount") + 0.0).alias("l_discount"))


def r6(c):
    return F.round(c, 6)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / l_quantity, 6) AS ppm2 FROM lineitem
WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_extendedprice > 0 AND l_quantity BETWEEN 5 AND 45 AND year(l_shipdate) BETWEEN 1995 AND 1998 AND l_extendedprice / l_quantity BETWEEN 900 AND 1500""")
def domain_gates(t):
    x = t.lineitem.where("l_returnflag = 'N' AND l_linestatus = 'O' AND l_extendedprice > 0 AND l_quantity BETWEEN 5 AND 45")
    x = x.where(F.year("l_shipdate").between(1995, 1998)).withColumn("ppm2", F.col("l_extendedprice") / F.col("l_quantity"))
    return x.where(F.col("ppm2").between(900, 1500)).select("l_orderkey", "l_linenumber", "l_partkey", r6("ppm2").alias("ppm2"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS k FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_shipdate, l_extendedprice ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS m FROM a WHERE k = 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM b WHERE m = 1""")
def two_stage_dedup(t):
    col = lambda *cs: [F.col(c) for c in cs]
    x = relational.keep_first(t.lineitem, ["l_orderkey", "l_linenumber"], col("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"))
    x = relational.keep_first(x, ["l_partkey", "l_shipdate", "l_extendedprice"], col("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"""WITH {MICRO_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY area_code, kind, market, year) AS c, ln(ppm2) AS l FROM micro),
s AS (SELECT *, CASE WHEN c >= 30 THEN concat_ws('|', 'f', area_code, kind, market, year) ELSE concat_ws('|', 'c', area_code, kind) END AS s FROM n),
d AS (SELECT *, abs(l - median(l) OVER (PARTITION BY s)) AS d FROM s), k AS (SELECT *, median(d) OVER (PARTITION BY s) AS mad FROM d)
SELECT area_code, count(*) AS n, round(avg(ppm2), 4) AS mean FROM k WHERE mad <= 0 OR d <= 1.5 * 1.4826 * mad GROUP BY area_code""")
def robust_trimmed(t):
    x = stats.robust_trim(micro(t), "ppm2", ["area_code", "kind", "market", "year"], ["area_code", "kind"], 30, 1.5)
    return x.groupBy("area_code").agg(F.count("*").alias("n"), F.round(F.avg("ppm2"), 4).alias("mean"))


@query("""WITH x AS (SELECT *, CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END AS comp, CASE WHEN l_tax > 0.04 THEN l_extendedprice * 2 ELSE 0 END AS whole, l_extendedprice * 3 AS total, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN (CASE WHEN comp > 0 THEN comp ELSE whole END) > 0 THEN CASE WHEN comp > 0 THEN comp ELSE whole END WHEN c = 1 AND total > 0 THEN total END AS price FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, round(price, 4) AS price FROM p""")
def price_coalesced(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).otherwise(0.0).alias("comp"), F.when(F.col("l_tax") > 0.04, F.col("l_extendedprice") * 2).otherwise(0.0).alias("whole"), (F.col("l_extendedprice") * 3).alias("total"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.round(relational.settled_price(x, "comp", "whole", "total", "l_orderkey"), 4).alias("price"))


@query("""SELECT c_custkey, lpad(regexp_replace(c_name, '[^0-9]', '', 'g'), greatest(length(regexp_replace(c_name, '[^0-9]', '', 'g')), 7)::INT, '0') AS code7,
substr(lpad(regexp_replace(c_name, '[^0-9]', '', 'g'), greatest(length(regexp_replace(c_name, '[^0-9]', '', 'g')), 7)::INT, '0'), 1, 6) AS code6 FROM customer""")
def codes_padded(t):
    return t.customer.select("c_custkey", codes.code7(F.col("c_name")).alias("code7"), codes.code6(F.col("c_name")).alias("code6"))


@query("SELECT c_custkey, round(try_cast(replace(replace(replace(CAST(c_acctbal AS VARCHAR), '.', ','), ' ', ''), ',', '.') AS DOUBLE), 2) AS bal FROM customer")
def text_numbers(t):
    return t.customer.select("c_custkey", F.round(parse.to_number(F.regexp_replace(F.col("c_acctbal").cast("string"), "\\.", ",")), 2).alias("bal"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_values(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"""WITH {MICRO_SQL} SELECT CASE market WHEN 'A' THEN 'primary' WHEN 'R' THEN 'secondary' ELSE 'unknown' END AS market, count(*) AS n, round(median(ppm2), 6) AS med FROM micro GROUP BY 1""")
def market_mix(t):
    named = F.when(F.col("market") == "A", "pierwotny").when(F.col("market") == "R", "wtorny")
    return micro(t).groupBy(parse.market_category(named).alias("market")).agg(F.count("*").alias("n"), r6(F.median("ppm2")).alias("med"))


@query(f"""WITH {MICRO_SQL}, m AS (SELECT area_code, region, market, avg(ppm2) AS v FROM micro GROUP BY 1, 2, 3),
x AS (SELECT area_code, region, market, CASE WHEN area_code % 3 = 0 THEN NULL ELSE v END AS v FROM m),
a AS (SELECT area_code, region, market, coalesce(v, median(v) OVER (PARTITION BY region, market)) AS v FROM x),
b AS (SELECT area_code, region, market, coalesce(v, median(v) OVER (PARTITION BY region)) AS v FROM a)
SELECT area_code, market, round(coalesce(v, median(v) OVER ()), 6) AS v FROM b""")
def imputed_hierarchy(t):
    m = micro(t).groupBy("area_code", "region", "market").agg(F.avg("ppm2").alias("v"))
    m = m.withColumn("v", F.when(F.col("area_code") % 3 != 0, F.col("v")))
    return stats.impute(m, "v", [["region", "market"], ["region"], []]).select("area_code", "market", r6("v").alias("v"))


@query(f"""WITH {MICRO_SQL}, g AS (SELECT area_code, region, median(price) AS m, count(*) AS n FROM micro WHERE rooms < 3 GROUP BY 1, 2),
r AS (SELECT region, median(price) AS m FROM micro WHERE rooms < 3 GROUP BY 1), a AS (SELECT median(price) AS m FROM micro WHERE rooms < 3)
SELECT n_nationkey AS area_code, CASE WHEN n >= 15 THEN 'area' WHEN r.m IS NOT NULL THEN 'region' ELSE 'all' END AS level, coalesce(n, 0) AS n,
round(ln(greatest(coalesce(CASE WHEN n >= 15 THEN g.m END, r.m, a.m), 1)), 6) AS log_land
FROM nation LEFT JOIN g ON n_nationkey = area_code LEFT JOIN r ON n_regionkey = r.region, a""")
def land_surface(t):
    land = micro(t).where("rooms < 3").select(F.col("area_code").alias("area"), "region", F.col("price").alias("land_ppm2"))
    x = transactions.land_surface(land, t.nation.select(F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("region")), ["area", "region"])
    return x.select(F.col("area").alias("area_code"), F.col("land_level").alias("level"), F.col("n_land").alias("n"), r6("log_land").alias("log_land"))


@query(f"""WITH {MICRO_SQL}, g AS (SELECT area_code, region, avg(ppm2) AS v, count(*) AS w FROM micro GROUP BY 1, 2)
SELECT area_code, round(v * (1000.0 + 10 * region) / (sum(v * w) OVER (PARTITION BY region) / sum(w) OVER (PARTITION BY region)), 6) AS benchmarked,
round(v - sum(v * w) OVER (PARTITION BY region) / sum(w) OVER (PARTITION BY region), 6) AS deviation FROM g""")
def benchmarked_index(t):
    g = micro(t).groupBy("area_code", "region").agg(F.avg("ppm2").alias("v"), F.count("*").alias("w"))
    f = (1000.0 + 10 * F.col("region")) / stats.group_mean(F.col("v"), F.col("w"), ["region"])
    return g.select("area_code", r6(F.col("v") * f).alias("benchmarked"), r6(stats.deviation(F.col("v"), F.col("w"), ["region"])).alias("deviation"))


@query("""WITH s AS (SELECT l_returnflag, l_quantity AS v, sum(l_extendedprice) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM s)
SELECT l_returnflag, min(v) AS weighted_median FROM c WHERE c >= t / 2 GROUP BY 1""")
def weighted_medians(t):
    return stats.weighted_median(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice")


@query("""WITH x AS (SELECT n_regionkey, c_custkey, c_acctbal + 2000 AS v FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT n_regionkey, sum(v) OVER (PARTITION BY n_regionkey ORDER BY v ROWS UNBOUNDED PRECEDING) / sum(v) OVER (PARTITION BY n_regionkey) AS s, v, count(*) OVER (PARTITION BY n_regionkey) AS n FROM x),
p AS (SELECT n_regionkey, n, s, lag(s) OVER (PARTITION BY n_regionkey ORDER BY v, s) AS p FROM s)
SELECT n_regionkey, round(1 - 2 * sum((s + p) / 2) / (max(n) - 1), 6) AS gini FROM p GROUP BY 1""")
def gini_by_region(t):
    x = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", (F.col("c_acctbal") + 2000).alias("v"))
    return stats.lorenz(x, ["n_regionkey"], "v").select("n_regionkey", r6("gini").alias("gini"))


@query("""WITH x AS (SELECT c_nationkey, count(*) AS n, sum(o_totalprice) AS s, avg(c_acctbal) AS b FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT round(regr_slope(ln(s), ln(n)), 6) AS slope, round(regr_intercept(ln(s), ln(n)), 6) AS intercept, round(corr(ln(s), ln(n)), 6) AS rho FROM x""")
def log_line(t):
    x = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    return x.agg(r6(F.regr_slope(F.ln("s"), F.ln("n"))).alias("slope"), r6(F.regr_intercept(F.ln("s"), F.ln("n"))).alias("intercept"), r6(F.corr(F.ln("s"), F.ln("n"))).alias("rho"))


@query("""SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.02), 4) AS p02, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.98), 4) AS p98, count(*) AS n, round(stddev_samp(o_totalprice), 4) AS sd FROM orders GROUP BY 1""")
def winsor_limits(t):
    p = lambda q: F.round(F.percentile("o_totalprice", F.lit(q)), 4)
    return t.orders.groupBy("o_orderstatus").agg(p(0.02).alias("p02"), F.round(F.median("o_totalprice"), 4).alias("med"), p(0.98).alias("p98"), F.count("*").alias("n"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"))


@query("""WITH e AS (SELECT quantile_cont(o_totalprice, [i / 10 FOR i IN range(11)]) AS e FROM orders)
SELECT CAST(least(len(list_filter(e, lambda x: x <= o_totalprice)), 10) AS INT) AS bin, round(avg(o_totalprice), 4) AS x, count(*) AS n FROM orders, e GROUP BY 1""")
def quantile_bins(t):
    x = stats.binned_means(t.orders, "o_totalprice", "o_totalprice", 10)
    return x.select("bin", F.round("x", 4).alias("x"), "n")


@query("""SELECT CAST(least(greatest(floor((c_acctbal + 1000) / 275), 0), 39) AS BIGINT) AS bucket, count(*) AS n FROM customer GROUP BY 1""")
def histogram(t):
    return t.customer.groupBy(F.least(F.greatest(F.floor((F.col("c_acctbal") + 1000) / 275), F.lit(0)), F.lit(39)).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, coalesce(count(*) FILTER (o_orderstatus = 'F'), 0) AS F, coalesce(count(*) FILTER (o_orderstatus = 'O'), 0) AS O, coalesce(count(*) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1""")
def count_pivot(t):
    return relational.counted(t.orders, "o_custkey", "o_orderstatus", ["F", "O", "P"])


def _round_trip(orders):
    x = orders.withColumn("h", F.concat_ws(";", "o_orderstatus", F.year("o_orderdate")))
    wide = x.groupBy(F.col("o_custkey").cast("string").alias("kod")).pivot("h").agg(F.sum("o_totalprice"))
    return relational.melted(wide, ["kod"], ["status", "year"]).where("value IS NOT NULL").withColumn("value", F.round("value", 4))


@query("SELECT CAST(o_custkey AS VARCHAR) AS kod, o_orderstatus AS status, CAST(year(o_orderdate) AS VARCHAR) AS year, round(sum(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2, 3")
def wide_round_trip(t):
    """Dimension-coded columns and back."""
    return _round_trip(t.orders)


@query("""WITH m AS (SELECT c_custkey, c_nationkey, c_acctbal, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rk, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS z FROM customer)
SELECT c_custkey, rk, round(z, 6) AS z FROM m""")
def ranks_and_scores(t):
    all_ = t.customer.agg(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s"))  # one row
    z = (F.col("c_acctbal") - F.col("m")) / F.col("s")
    return t.customer.crossJoin(F.broadcast(all_)).select("c_custkey", F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))).cast("long").alias("rk"), r6(z).alias("z"))


@query("""SELECT c_custkey, c_nationkey, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey), 9) AS share FROM (
SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3""")
def top_candidates(t):
    w = Window.partitionBy("c_nationkey")
    x = t.customer.withColumn("k", F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey"))).where("k <= 3")
    return x.select("c_custkey", "c_nationkey", F.round(F.col("c_acctbal") / F.sum("c_acctbal").over(w), 9).alias("share"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (SELECT o_custkey AS k, count(*) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
FULL JOIN (SELECT o_custkey AS k, count(*) AS y FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) b ON a.k = b.k""")
def outer_combined(t):
    a = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("x"))
    b = t.orders.where("o_orderpriority LIKE '1%'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("y"))
    return relational.outer_all([a, b], "k").na.fill(0)


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y FROM orders WHERE year(o_orderdate) = (SELECT coalesce(max(year(o_orderdate)) FILTER (year(o_orderdate) <= 2000), min(year(o_orderdate))) FROM orders)")
def latest_earlier_year(t):
    return relational.for_year(t.orders.withColumn("y", F.year("o_orderdate")), "y", 2000).select("o_orderkey", "y")


@query(f"""WITH {MICRO_SQL}, m AS (SELECT area_code, ln(ppm2) AS y, ln(area) AS x FROM micro),
d AS (SELECT area_code, y, x, y - avg(y) OVER (PARTITION BY area_code) AS yd, x - avg(x) OVER (PARTITION BY area_code) AS xd FROM m),
b AS (SELECT sum(xd * yd) / (sum(xd * xd) + 1e-6) AS b FROM d)
SELECT area_code, round(avg(y - b * (x - mx)), 5) AS theta, count(*) AS n FROM (SELECT m.*, avg(x) OVER () AS mx FROM m), b GROUP BY area_code""")
def hedonic_areas(t):
    x = micro(t).select("area_code", F.ln("ppm2").alias("y"), "area")
    x = hedonic.centred(x, {"log_area": F.ln("area")})
    out, _ = hedonic.fitted(x, "y", ["log_area"], "area_code")
    return out.select("area_code", F.round("theta", 5).alias("theta"), "n")


def _hedonic(t):
    m = micro(t).select("area_code", "ppm2", "area", F.lit("flat").alias("kind"), F.when(F.col("market") == "A", "primary").when(F.col("market") == "R", "secondary").otherwise("unknown").alias("market"), F.when(F.col("rooms") % 5 != 0, F.col("rooms")).alias("rooms"), F.when(F.col("rooms") % 3 == 0, F.col("rooms") % 7).alias("floor"), F.lit(None).cast("int").alias("floors"))
    x, cols = hedonic.controls(m)
    cols = [c for c in cols if c not in ("house", "bld_floors", "has_bld_floors")]
    return hedonic.fitted(x.withColumn("y", F.ln("ppm2")), "y", cols, "area_code")[0]


@query()
def hedonic_full(t):
    return _hedonic(t).select("area_code", F.round("theta", 5).alias("theta"), F.round("d", 9).alias("d"), "n")


@query()
def area_model(t):
    """Fay-Herriot shrinkage of the hedonic effects; areas without data take the synthetic value."""
    x = t.nation.select(F.col("n_nationkey").alias("area_code"), F.col("n_regionkey").alias("region")).join(_hedonic(t), "area_code", "left")
    x = x.withColumn("theta", F.when(F.col("area_code") != 7, F.col("theta"))).withColumn("urban", (F.col("region") % 2).cast("double"))
    return hedonic.shrunk(x, "area_code", ["urban"]).select("area_code", *[F.round(c, 5).alias(c) for c in ("theta_tilde", "sd", "gamma", "index")])


@query(f"""WITH {MICRO_SQL}, c AS (SELECT area_code, ln(ppm2) AS y, ln(area) - avg(ln(area)) OVER () AS x FROM micro),
d AS (SELECT area_code, avg(x) OVER (PARTITION BY area_code) AS m, y - avg(y) OVER (PARTITION BY area_code) AS yd, x - avg(x) OVER (PARTITION BY area_code) AS z FROM c),
b AS (SELECT sum(z * yd) / (sum(z * z) + 1e-6) AS b, 1 / (sum(z * z) + 1e-6) AS q, count(*) AS n, count(DISTINCT area_code) AS k FROM d),
u AS (SELECT area_code, m, z, (yd - b * z) * (yd - b * z) AS s FROM d, b),
t AS (SELECT sum(s * z * z) AS t FROM u),
g AS (SELECT area_code, count(*) AS c, min(m) AS m, sum(s) AS o, sum(s * z) AS sz FROM u GROUP BY 1)
SELECT area_code, round((o / c / c - 2 * m * q * sz / c + m * m * q * q * t) * n / (n - 1 - k) * 1e6, 5) AS d FROM g, b, t""")
def hedonic_variances(t):
    """HC1 variances of area effects, with the control's share."""
    x = hedonic.centred(micro(t).select("area_code", F.ln("ppm2").alias("y"), "area"), {"log_area": F.ln("area")})
    return hedonic.fitted(x, "y", ["log_area"], "area_code")[0].select("area_code", F.round(F.col("d") * 1e6, 5).alias("d"))
