"""Origin-destination matrices as long tables (n, i, value): n is the residence, i the workplace."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _by(*cols: str):
    return Window.partitionBy(*cols)


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir (one of our own where unset) and read again, so loops stay short."""
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "file://" + os.path.join(os.environ.get("TMPDIR", "/tmp"), "terrano-loops")
    path = f"{base.rstrip('/')}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(*frames: DataFrame) -> None:
    """Deletes tables of cut() that a loop has passed."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark) -> None:
    """Lets Spark delete the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def margins(od: DataFrame) -> DataFrame:
    """(code, out, into, own): off-diagonal sums by row and column, and the diagonal."""
    off = F.when(F.col("n") != F.col("i"), F.col("value")).otherwise(0.0)
    rows = od.groupBy(F.col("n").alias("code")).agg(F.sum(off).alias("out"), F.sum(F.when(F.col("n") == F.col("i"), F.col("value"))).alias("own"))
    cols = od.groupBy(F.col("i").alias("code")).agg(F.sum(off).alias("into"))
    return rows.join(cols, "code", "full").na.fill(0.0)


def shares(od: DataFrame) -> DataFrame:
    """uncond: share of the whole; cond: share of the row."""
    total = od.agg(F.sum("value").alias("t"))
    return od.crossJoin(F.broadcast(total)).withColumn("uncond", F.col("value") / F.col("t")).withColumn("cond", F.col("value") / F.sum("value").over(_by("n"))).drop("t")


def recovered_diagonal(od: DataFrame, residents: DataFrame) -> DataFrame:
    """The diagonal as max(residents - out, 0); residents (n, r)."""
    out = od.where("n != i").groupBy("n").agg(F.sum("value").alias("out"))
    own = residents.join(out, "n", "left").select("n", F.col("n").alias("i"), F.greatest(F.col("r") - F.coalesce("out", F.lit(0.0)), F.lit(0.0)).alias("value"))
    return od.where("n != i").select("n", "i", "value").unionByName(own)


def ipf(od: DataFrame, rows: DataFrame, cols: DataFrame, tau: DataFrame | None = None, phi: float = 2.0, floor: float = 1e-6, rounds: int = 200, tol: float = 1e-9) -> DataFrame:
    """Iterative proportional fitting to margins rows (n, r) and cols (i, c), both scaled to their mean total first.

    A small floor (with tau (n, i, tau): times tau**-phi off the diagonal) makes empty cells reachable.
    """
    if tau is None:
        m = od.withColumn("value", F.col("value") + floor)
    else:
        m = od.join(tau, ["n", "i"]).withColumn("value", F.col("value") + F.when(F.col("n") == F.col("i"), F.lit(floor)).otherwise(floor * F.pow("tau", F.lit(-phi)))).drop("tau")
    r, c = rows.agg(F.sum("r")).first()[0], cols.agg(F.sum("c")).first()[0]
    t = (r + c) / 2
    # the matrix never changes: each side has a factor for each unit, and a round is an aggregation for either side
    m = cut(m.select("n", "i", "value").join(F.broadcast(rows.select("n")), "n", "left_semi").join(F.broadcast(cols.select("i")), "i", "left_semi"))
    r_, c_ = rows.select("n", (F.col("r") * (t / r)).alias("r")), cols.select("i", (F.col("c") * (t / c)).alias("c"))
    b = cut(c_.select("i", F.lit(1.0).alias("b")))
    for k in range(rounds):
        reach = m.join(F.broadcast(b), "i").groupBy("n").agg(F.sum(F.col("value") * F.col("b")).alias("s")).join(F.broadcast(r_), "n")
        a = reach.select("n", (F.col("r") / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("a"))
        before = b
        reach = m.join(F.broadcast(a), "n").groupBy("i").agg(F.sum(F.col("value") * F.col("a")).alias("s")).join(F.broadcast(c_), "i")
        b = cut(reach.select("i", (F.col("c") / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("b")))
        if k == rounds - 1:
            break
        if tol > 0 and k % 4 == 3:
            e = m.join(F.broadcast(b), "i").join(F.broadcast(a), "n").groupBy("n").agg(F.sum(F.col("value") * F.col("a") * F.col("b")).alias("s")).join(r_, "n")
            e = e.agg(F.max(F.abs(F.col("s") - F.col("r")))).first()[0]
            if e is None or e < tol * t:
                break
        drop_cut(before)
    return m.join(F.broadcast(a), "n").join(F.broadcast(b), "i").select("n", "i", (F.col("value") * F.col("a") * F.col("b")).alias("value"))


def absorbed(df: DataFrame, values: list[str], rounds: int = 200, tol: float = 1e-10) -> DataFrame:
    """Two-way demeaned columns; on a complete panel one closed-form pass is exact, else passes repeat."""
    sizes = df.agg(F.count("*"), F.count_distinct("n"), F.count_distinct("i")).first()
    if sizes[0] == sizes[1] * sizes[2]:
        whole = df.agg(*[F.avg(v).alias(f"__{v}") for v in values])  # one row
        return df.crossJoin(F.broadcast(whole)).select(*[c for c in df.columns if c not in values], *[(F.col(v) - F.avg(v).over(_by("n")) - F.avg(v).over(_by("i")) + F.col(f"__{v}")).alias(v) for v in values])
    old = None
    for k in range(rounds):
        df = df.select(*[c for c in df.columns if c not in values], *[(F.col(v) - F.avg(v).over(_by("n"))).alias(v) for v in values])
        df = df.withColumns({f"__{v}": F.avg(v).over(_by("i")) for v in values})
        df = cut(df.withColumns({v: F.col(v) - F.col(f"__{v}") for v in values}))
        if old is not None:
            drop_cut(old)
        old = df
        adj = df.agg(*[F.max(F.abs(f"__{v}")) for v in values]).first()
        df = df.drop(*[f"__{v}" for v in values])
        if max(x or 0.0 for x in adj) < tol:
            break
    return df


def gravity(od: DataFrame, tau: DataFrame, diagonal: bool = False) -> DataFrame:
    """phi of log flow = fe_n + fe_i - phi log tau on positive pairs, HC1 error, within R2, pairs (one row)."""
    x = od.join(tau, ["n", "i"]).where("value > 0 AND tau > 0")
    x = x if diagonal else x.where("n != i")
    x = absorbed(x.select("n", "i", F.ln("value").alias("y"), F.ln("tau").alias("x")), ["y", "x"])
    s = x.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.count("*").alias("m"), F.count_distinct("n").alias("k"))
    e = x.crossJoin(F.broadcast(s.withColumn("b", F.col("xy") / F.col("xx")))).withColumn("e", F.col("y") - F.col("b") * F.col("x"))
    a = e.groupBy("b", "xx", "yy", "m", "k").agg(F.sum(F.col("x") ** 2 * F.col("e") ** 2).alias("meat"), F.sum(F.col("e") ** 2).alias("sse"))
    dof = F.greatest(F.col("m") - 2 * F.col("k"), F.lit(1))
    return a.select((-F.col("b")).alias("phi"), F.sqrt(F.col("meat") / F.col("xx") ** 2 * F.col("m") / dof).alias("se"), (1 - F.col("sse") / F.col("yy")).alias("r2"), F.col("m").alias("pairs"))


def market_access(tau: DataFrame, wages: DataFrame, eps: float, mu: float) -> DataFrame:
    """(n, cma): sum over i of tau**(-eps mu) * w_i**eps; wages (i, w)."""
    return tau.join(F.broadcast(wages), "i").groupBy("n").agg(F.sum(F.pow("tau", F.lit(-eps * mu)) * F.pow("w", F.lit(eps))).alias("cma"))


def trade_cost(tau: DataFrame, psi: float) -> DataFrame:
    """(n, i, d): (t / min t)**psi of the symmetrised times t = sqrt(tau * tau')."""
    back = tau.select(F.col("n").alias("i"), F.col("i").alias("n"), F.col("tau").alias("rev"))
    x = tau.join(back, ["n", "i"]).withColumn("t", F.sqrt(F.col("tau") * F.col("rev")))
    least = x.agg(F.min("t").alias("least"))
    return x.crossJoin(F.broadcast(least)).select("n", "i", F.pow(F.col("t") / F.col("least"), F.lit(psi)).alias("d"))


def repaired_times(tau: DataFrame, area: DataFrame | None = None, speed: float = 50.0, c: float = 2 / 3, floor: float = 3.0) -> DataFrame:
    """Non-positive times: off the diagonal the least positive one there, on it `floor`; with area (n, a) own times are c sqrt(a/pi)/speed*60."""
    off = tau.where("n != i AND tau > 0").agg(F.min("tau").alias("least"))
    x = tau.crossJoin(F.broadcast(off))
    own = F.when(F.col("tau") > 0, F.col("tau")).otherwise(floor)
    if area is not None:
        x = x.join(F.broadcast(area), "n", "left")
        own = F.greatest(c * F.sqrt(F.col("a") / F.lit(3.141592653589793)) / speed * 60, F.lit(floor))
    return x.select("n", "i", F.when(F.col("n") == F.col("i"), own).when(F.col("tau") > 0, F.col("tau")).otherwise(F.col("least")).alias("tau"))


def points_to_areas(times: DataFrame, member: DataFrame) -> DataFrame:
    """(n, i, tau) in minutes from point-to-point seconds (o, d, sec) and weighted members (code, point, w)."""
    a = member.select(F.col("code").alias("n"), F.col("point").alias("o"), F.col("w").alias("wo"))
    b = member.select(F.col("code").alias("i"), F.col("point").alias("d"), F.col("w").alias("wd"))
    return times.join(a, "o").join(b, "d").groupBy("n", "i").agg((F.sum(F.col("wo") * F.col("wd") * F.col("sec")) / 60).alias("tau"))


def generated(tau: DataFrame, wages: DataFrame, residents: DataFrame, jobs: DataFrame, eps: float, mu: float, rounds: int = 2000, tol: float = 1e-3) -> DataFrame:
    """Flows whose column sums meet jobs (i, l) given residents (n, r): B_i grows by L / L-hat until they do."""
    m = tau.join(F.broadcast(wages), "i").join(F.broadcast(residents.select("n")), "n", "left_semi")
    m = cut(m.select("n", "i", (F.pow("w", F.lit(eps)) * F.pow("tau", F.lit(-eps * mu))).alias("u")).join(F.broadcast(jobs.select("i")), "i", "left_semi"))
    old, b = None, cut(jobs.select("i", F.lit(1.0).alias("b")))
    for k in range(rounds):
        a = m.join(F.broadcast(b), "i").groupBy("n").agg(F.sum(F.col("b") * F.col("u")).alias("s")).join(F.broadcast(residents), "n").select("n", (F.col("r") / F.col("s")).alias("a"))
        hat = m.join(F.broadcast(a), "n").groupBy("i").agg(F.sum(F.col("a") * F.col("u")).alias("s"))
        step = cut(jobs.select("i", "l").join(b, "i").join(hat, "i").select("i", "l", "b", (F.col("b") * F.col("s")).alias("hat")))
        gap = step.agg(F.sum(F.abs(F.col("l") - F.col("hat")))).first()[0]
        if gap is None or 100 * gap < tol or k == rounds - 1:
            break
        if old is not None:
            drop_cut(old)
        old, b = step, step.select("i", (F.col("b") * F.col("l") / F.col("hat")).alias("b"))
    return m.join(F.broadcast(a), "n").join(F.broadcast(b), "i").select("n", "i", (F.col("a") * F.col("b") * F.col("u")).alias("value"))


def effective_cost(tau: DataFrame, modes: list | None = None, congestion: dict | None = None) -> DataFrame:
    """Travel times as they are; further modes and congestion are places for extensions and not built."""
    if modes:
        raise NotImplementedError("further modes")
    if congestion is not None:
        raise NotImplementedError("congestion")
    return tau
