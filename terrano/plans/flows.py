"""Origin-destination, labour-market and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import model, od, relational, stats
from ..streaming import windows
from .base import Tables, query

OD_SQL = """od AS (
  SELECT c_nationkey AS n, s_nationkey AS i, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY c_nationkey, s_nationkey)"""
TAU_SQL = """tau AS (
  SELECT a.n_nationkey AS n, b.n_nationkey AS i, 3.0::DOUBLE + abs(a.n_nationkey - b.n_nationkey) + a.n_nationkey % 3 AS tau
  FROM nation a, nation b)"""


def matrix(t: Tables) -> DataFrame:
    """Quantities by the customer's and the supplier's nation."""
    x = t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("n")), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("i")), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy("n", "i").agg(F.sum("l_quantity").alias("value"))


def times(t: Tables) -> DataFrame:
    """Minutes between nations; their number is fixed, so all pairs are few."""
    a, b = t.nation.select(F.col("n_nationkey").alias("n")), t.nation.select(F.col("n_nationkey").alias("i"))
    return a.crossJoin(b).withColumn("tau", F.lit(3.0) + F.abs(F.col("n") - F.col("i")) + F.col("n") % 3)


def r6(c) -> F.Column:
    return F.round(c, 6)


@query(f"WITH {OD_SQL} SELECT n, i, round(value, 6) AS value FROM od")
def od_matrix(t):
    return matrix(t).select("n", "i", r6("value").alias("value"))


@query(f"""WITH {OD_SQL}, a AS (SELECT n AS code, sum(CASE WHEN n <> i THEN value ELSE 0 END) AS o, sum(CASE WHEN n = i THEN value END) AS own FROM od GROUP BY n),
b AS (SELECT i AS code, sum(CASE WHEN n <> i THEN value ELSE 0 END) AS into_ FROM od GROUP BY i)
SELECT coalesce(a.code, b.code) AS code, round(coalesce(o, 0), 6) AS out, round(coalesce(into_, 0), 6) AS into, round(coalesce(own, 0), 6) AS own FROM a FULL JOIN b ON a.code = b.code""")
def od_margins(t):
    return od.margins(matrix(t)).select("code", *[r6(c).alias(c) for c in ("out", "into", "own")])


@query(f"""WITH {OD_SQL} SELECT n, i, round(value / sum(value) OVER (), 9) AS uncond, round(value / sum(value) OVER (PARTITION BY n), 9) AS cond FROM od""")
def od_shares(t):
    return od.shares(matrix(t)).select("n", "i", F.round("uncond", 9).alias("uncond"), F.round("cond", 9).alias("cond"))


@query(f"""WITH {OD_SQL}, r AS (SELECT n, 1.1::DOUBLE * sum(value) - 100 * n AS r FROM od GROUP BY n),
o AS (SELECT n, sum(value) AS o FROM od WHERE n <> i GROUP BY n)
SELECT n, i, round(value, 6) AS value FROM od WHERE n <> i UNION ALL
SELECT r.n, r.n, round(greatest(r - coalesce(o, 0), 0), 6) FROM r LEFT JOIN o ON r.n = o.n""")
def diagonal_recovered(t):
    m = matrix(t)
    r = m.groupBy("n").agg((F.lit(1.1) * F.sum("value") - 100 * F.col("n")).alias("r"))
    return od.recovered_diagonal(m, r).select("n", "i", r6("value").alias("value"))


def targets(t: Tables) -> tuple[DataFrame, DataFrame]:
    r = t.customer.groupBy(F.col("c_nationkey").alias("n")).agg(F.count("*").cast("double").alias("r"))
    c = t.supplier.groupBy(F.col("s_nationkey").alias("i")).agg((F.count("*") * 15.0).alias("c"))
    return r, c


@query(f"""WITH RECURSIVE {OD_SQL},
r AS (SELECT c_nationkey AS n, count(*)::DOUBLE AS r FROM customer GROUP BY c_nationkey),
c AS (SELECT s_nationkey AS i, count(*) * 15.0::DOUBLE AS c FROM supplier GROUP BY s_nationkey),
t AS (SELECT ((SELECT sum(r) FROM r) + (SELECT sum(c) FROM c)) / 2 AS t),
m0 AS (SELECT od.n, od.i, value + 1e-6::DOUBLE AS v, r * t / (SELECT sum(r) FROM r) AS r, c * t / (SELECT sum(c) FROM c) AS c FROM od JOIN r ON od.n = r.n JOIN c ON od.i = c.i, t),
m(k, n, i, v, r, c) AS (
  SELECT 0, n, i, v, r, c FROM m0 UNION ALL
  SELECT k + 1, n, i, v * c / sum(v) OVER (PARTITION BY i), r, c FROM (SELECT k, n, i, v * r / sum(v) OVER (PARTITION BY n) AS v, r, c FROM m WHERE k < 12))
SELECT n, i, round(v, 5) AS value FROM m WHERE k = 12""")
def ipf_reconciled(t):
    r, c = targets(t)
    return od.ipf(matrix(t), r, c, rounds=12, tol=0.0).select("n", "i", F.round("value", 5).alias("value"))


@query()
def ipf_converged(t):
    """ipf_reconciled, whose SQL has 12 rounds, to the operator's tolerance; no SQL: tested against a plain loop."""
    r, c = targets(t)
    return od.ipf(matrix(t), r, c).select("n", "i", F.round("value", 5).alias("value"))


@query(f"""WITH {OD_SQL}, {TAU_SQL},
l AS (SELECT n, i, ln(value) AS y, ln(tau) AS x FROM od JOIN tau USING (n, i) WHERE value > 0),
d AS (SELECT n, i, y - avg(y) OVER (PARTITION BY n) - avg(y) OVER (PARTITION BY i) + avg(y) OVER () AS y, x - avg(x) OVER (PARTITION BY n) - avg(x) OVER (PARTITION BY i) + avg(x) OVER () AS x FROM l),
b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, sum(y * y) AS yy, count(*) AS m, count(DISTINCT n) AS k FROM d),
e AS (SELECT sum(x * x * (y - b * x) * (y - b * x)) AS meat, sum((y - b * x) * (y - b * x)) AS sse FROM d, b)
SELECT round(-b, 6) AS phi, round(sqrt(meat / (xx * xx) * m / greatest(m - 2 * k, 1)), 6) AS se, round(1 - sse / yy, 6) AS r2, m AS pairs FROM b, e""")
def gravity_phi(t):
    return od.gravity(matrix(t), times(t), diagonal=True).select(r6("phi").alias("phi"), r6("se").alias("se"), r6("r2").alias("r2"), "pairs")


@query()
def gravity_off_diagonal(t):
    return od.gravity(matrix(t), times(t)).select(r6("phi").alias("phi"), r6("se").alias("se"), r6("r2").alias("r2"), "pairs")


@query(f"""WITH {TAU_SQL}, w AS (SELECT s_nationkey AS i, 1 + avg(s_acctbal) / 10000 AS w FROM supplier GROUP BY s_nationkey)
SELECT n, round(sum(tau ** (-4.6 * 0.47) * w ** 4.6), 6) AS cma FROM tau JOIN w USING (i) GROUP BY n""")
def market_access(t):
    w = t.supplier.groupBy(F.col("s_nationkey").alias("i")).agg((1 + F.avg("s_acctbal") / 10000).alias("w"))
    return od.market_access(times(t), w, 4.6, 0.47).select("n", r6("cma").alias("cma"))


@query(f"""WITH {TAU_SQL}, t AS (SELECT a.n, a.i, sqrt(a.tau * b.tau) AS t FROM tau a JOIN tau b ON a.n = b.i AND a.i = b.n)
SELECT n, i, round((t / min(t) OVER ()) ** 0.42, 6) AS d FROM t""")
def trade_costs(t):
    return od.trade_cost(times(t), 0.42).select("n", "i", r6("d").alias("d"))


@query(f"""WITH {TAU_SQL}, x AS (SELECT n, i, CASE WHEN (n + i) % 7 = 0 THEN 0.0::DOUBLE ELSE tau END AS tau FROM tau)
SELECT n, i, round(CASE WHEN n = i THEN CASE WHEN tau > 0 THEN tau ELSE 3 END WHEN tau > 0 THEN tau ELSE (SELECT min(tau) FROM x WHERE n <> i AND tau > 0) END, 6) AS tau FROM x""")
def times_repaired(t):
    x = times(t).withColumn("tau", F.when((F.col("n") + F.col("i")) % 7 == 0, 0.0).otherwise(F.col("tau")))
    return od.repaired_times(x).select("n", "i", r6("tau").alias("tau"))


@query(f"""WITH {TAU_SQL}, m AS (SELECT n_regionkey AS code, n_nationkey AS point, 1.0::DOUBLE / count(*) OVER (PARTITION BY n_regionkey) AS w FROM nation)
SELECT a.code AS n, b.code AS i, round(sum(a.w * b.w * tau * 60) / 60, 6) AS tau FROM tau JOIN m a ON tau.n = a.point JOIN m b ON tau.i = b.point GROUP BY a.code, b.code""")
def area_times(t):
    m = t.nation.select(F.col("n_regionkey").alias("code"), F.col("n_nationkey").alias("point"), (1.0 / F.count("*").over(Window.partitionBy("n_regionkey"))).alias("w"))
    sec = times(t).select(F.col("n").alias("o"), F.col("i").alias("d"), (F.col("tau") * 60).alias("sec"))
    return od.points_to_areas(sec, m).select("n", "i", r6("tau").alias("tau"))


@query(f"""WITH {OD_SQL}, x AS (SELECT n_nationkey AS src, n_regionkey AS dst FROM nation)
SELECT a.dst AS res, b.dst AS work, round(sum(value), 6) AS count FROM od JOIN x a ON n = a.src JOIN x b ON i = b.src GROUP BY a.dst, b.dst""")
def flows_harmonised(t):
    walk = t.nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"), F.lit(1.0).alias("weight"))
    m = matrix(t).select(F.col("n").alias("res"), F.col("i").alias("work"), F.col("value").alias("count"))
    return relational.recoded_flows(m, walk).select("res", "work", r6("count").alias("count"))


@query()
def flows_generated(t):
    """The flows themselves, run to the tolerance; no SQL: tested against a plain loop."""
    return _generated(t).select("n", "i", r6("value").alias("value"))


def _generated(t):
    m = matrix(t)
    w = t.nation.select(F.col("n_nationkey").alias("i"), (1.0 + F.col("n_nationkey") / 50.0).alias("w"))
    res = m.groupBy("n").agg(F.sum("value").alias("r"))
    jobs = m.groupBy("i").agg(F.sum("value").alias("l"))
    return od.generated(times(t), w, res, jobs, 4.6, 0.47)


def _model_input(t: Tables) -> DataFrame:
    d = od.trade_cost(times(t), 0.42)
    w = t.nation.select(F.col("n_nationkey").alias("i"), (1.0 + F.col("n_nationkey") / 100.0).alias("w"))
    return times(t).join(matrix(t), ["n", "i"], "left").na.fill({"value": 1e-3}).join(d, ["n", "i"]).join(F.broadcast(w), "i").withColumn("grp", F.lit(1)).withColumn("q", 1.0 + F.col("n") / 40.0)


@query()
def model_calibrated(t):
    x = model.calibrated(_model_input(t))
    return x.select("code", *[r6(c).alias(c) for c in ("a", "price", "amenity", "cma")], (F.col("gap") < 1e-6).alias("balanced"))


@query("SELECT 1 AS grp, 1.0::DOUBLE AS welfare, 0.0::DOUBLE AS spread, 0.0::DOUBLE AS sd_r, 0.0::DOUBLE AS sd_l")
def counterfactual_identity(t):
    """All changes one: welfare must stay one."""
    x = model.network_effect(_model_input(t).withColumn("tau_new", F.col("tau")))
    return x.select("grp", *[F.abs(F.round(c, 5)).alias(c) for c in ("welfare", "spread", "sd_r", "sd_l")])


@query()
def counterfactual_network(t):
    x = model.network_effect(_model_input(t).withColumn("tau_new", F.when(F.col("n") != F.col("i"), F.col("tau") * 0.9).otherwise(F.col("tau"))))
    return x.select("grp", *[F.round(c, 4).alias(c) for c in ("welfare", "spread", "sd_r", "sd_l")])


@query("""WITH p AS (SELECT s_nationkey, avg(s_acctbal) AS w, count(*) AS e FROM supplier GROUP BY s_nationkey),
x AS (SELECT n_regionkey, n_nationkey, w, e, 5000.0::DOUBLE + 100 * n_regionkey AS target FROM p JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT *, greatest(w / (sum(w * e) OVER (PARTITION BY n_regionkey) / sum(e) OVER (PARTITION BY n_regionkey)), 1e-3) AS r FROM x)
SELECT n_nationkey, round(target * r ** 0.9 * sum(e) OVER (PARTITION BY n_regionkey) / sum(e * r ** 0.9) OVER (PARTITION BY n_regionkey), 6) AS wage FROM r""")
def wages_disaggregated(t):
    """County wages spread by the damped relative wage, so that the employment-weighted mean meets the county's."""
    p = t.supplier.groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("w"), F.count("*").alias("e"))
    x = p.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("target", F.lit(5000.0) + 100 * F.col("n_regionkey"))
    g = Window.partitionBy("n_regionkey")
    x = x.withColumn("r", F.greatest(F.col("w") / stats.group_mean(F.col("w"), F.col("e"), ["n_regionkey"]), F.lit(1e-3)))
    rl = F.pow("r", F.lit(0.9))
    return x.select("n_nationkey", r6(F.col("target") * rl * F.sum("e").over(g) / F.sum(F.col("e") * rl).over(g)).alias("wage"))


@query(f"""WITH {OD_SQL}, m AS (SELECT n, sum(CASE WHEN n <> i THEN value ELSE 0 END) AS o FROM od GROUP BY n),
k AS (SELECT i, sum(CASE WHEN n <> i THEN value ELSE 0 END) AS into_, sum(value) AS l FROM od GROUP BY i),
r AS (SELECT n_regionkey, n_nationkey, greatest(coalesce(l, 0) - coalesce(into_, 0), 0) + coalesce(o, 0) AS r FROM nation LEFT JOIN m ON n_nationkey = n LEFT JOIN k ON n_nationkey = i)
SELECT n_nationkey, round(r * 1000000 / sum(r) OVER (PARTITION BY n_regionkey), 6) AS residents FROM r""")
def residents_raked(t):
    m = matrix(t)
    g = od.margins(m).select(F.col("code").alias("n_nationkey"), "out", "into")
    jobs = m.groupBy(F.col("i").alias("n_nationkey")).agg(F.sum("value").alias("l"))
    x = t.nation.join(g, "n_nationkey", "left").join(jobs, "n_nationkey", "left").na.fill(0.0)
    r = F.greatest(F.col("l") - F.col("into"), F.lit(0.0)) + F.col("out")
    return x.withColumn("r", r).select("n_nationkey", r6(stats.raked(F.col("r"), F.lit(1_000_000.0), ["n_regionkey"])).alias("residents"))


@query("""WITH w AS (SELECT user_id, avg(value) AS m FROM events WHERE day(ts) BETWEEN 24 AND 30 GROUP BY user_id),
h AS (SELECT user_id, avg(value) AS m FROM events WHERE day(ts) < 24 GROUP BY user_id)
SELECT coalesce(w.user_id, h.user_id) AS user_id, round(coalesce(w.m, h.m), 6) AS wage, CASE WHEN w.m IS NOT NULL THEN 'window' ELSE 'history' END AS source
FROM w FULL JOIN h ON w.user_id = h.user_id""")
def recent_wage(t):
    e = t.events.select("user_id", "value", F.dayofmonth("ts").alias("day"))
    w = stats.trailing_mean(e, ["user_id"], "day", "value", 30, 7).select("user_id", F.col("mean").alias("w"))
    h = e.where("day < 24").groupBy("user_id").agg(F.avg("value").alias("h"))
    return w.join(h, "user_id", "full").select("user_id", r6(F.coalesce("w", "h")).alias("wage"), F.when(F.col("w").isNotNull(), "window").otherwise("history").alias("source"))


@query("SELECT date_trunc('day', ts) AS day, event_type, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1, 2")
def events_daily(t):
    return windows.daily_means(t.events).select("day", "event_type", r6("mean").alias("mean"), "n")


@query("""SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS kinds, count(*) AS n FROM events GROUP BY user_id""")
def id_sets(t):
    return t.events.groupBy("user_id").agg(relational.joined_ids("event_type").alias("kinds"), F.count("*").alias("n"))


@query("""WITH y AS (SELECT o_custkey % 500 AS code, CAST(year(o_orderdate) AS INT) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
g AS (SELECT DISTINCT code FROM y), p AS (SELECT code, k.y FROM g, (SELECT DISTINCT y FROM y) k),
f AS (SELECT p.code, p.y, v FROM p LEFT JOIN y ON p.code = y.code AND p.y = y.y),
w AS (SELECT code, y, v, last_value(v IGNORE NULLS) OVER a AS a, last_value(CASE WHEN v IS NOT NULL THEN y END IGNORE NULLS) OVER a AS pa,
  first_value(v IGNORE NULLS) OVER b AS b, first_value(CASE WHEN v IS NOT NULL THEN y END IGNORE NULLS) OVER b AS pb FROM f
  WINDOW a AS (PARTITION BY code ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY code ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT code, y, round(CASE WHEN v IS NOT NULL THEN v WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a + (b - a) * (y - pa) / (pb - pa) END, 4) AS v FROM w""")
def years_interpolated(t):
    y = t.orders.groupBy((F.col("o_custkey") % 500).alias("code"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    grid = y.select("code").distinct().crossJoin(F.broadcast(y.select("y").distinct()))
    return relational.interpolated(grid.join(y, ["code", "y"], "left"), "code", "y", "v").select("code", "y", F.round("v", 4).alias("v"))


@query(f"""WITH {OD_SQL}, l AS (SELECT i, sum(value) AS l FROM od GROUP BY i), r AS (SELECT n, sum(value) AS r FROM od GROUP BY n)
SELECT metric, round(value, 6) AS value FROM (
SELECT 'mean_log_l' AS metric, avg(ln(l)) AS value FROM l UNION ALL SELECT 'sd_log_l', stddev_pop(ln(l)) FROM l UNION ALL SELECT 'min_log_l', min(ln(l)) FROM l UNION ALL SELECT 'max_log_l', max(ln(l)) FROM l UNION ALL
SELECT 'own_share', sum(CASE WHEN n = i THEN value END) / sum(value) FROM od UNION ALL SELECT 'corr_lr', corr(ln(l), ln(r)) FROM l JOIN r ON l.i = r.n)""")
def report_moments(t):
    m = matrix(t)
    l, r = m.groupBy("i").agg(F.sum("value").alias("l")), m.groupBy("n").agg(F.sum("value").alias("r"))
    a = l.agg(F.avg(F.ln("l")).alias("mean_log_l"), F.stddev_pop(F.ln("l")).alias("sd_log_l"), F.min(F.ln("l")).alias("min_log_l"), F.max(F.ln("l")).alias("max_log_l"))
    b = m.agg((F.sum(F.when(F.col("n") == F.col("i"), F.col("value"))) / F.sum("value")).alias("own_share"))
    c = l.join(r, F.col("i") == F.col("n")).agg(F.corr(F.ln("l"), F.ln("r")).alias("corr_lr"))
    wide = a.crossJoin(b).crossJoin(c)
    return wide.unpivot([], wide.columns, "metric", "value").select("metric", r6("value").alias("value"))
