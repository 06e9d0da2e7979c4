"""Windowed and robust statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def robust_trim(df: DataFrame, value: str, fine: Sequence[str], coarse: Sequence[str], least: int = 30, z: float = 4.0) -> DataFrame:
    """Keeps |log value - median| <= z * 1.4826 * MAD by stratum: the fine one if it has `least` rows, else the coarse one
    (whose statistics use only the rows that fell back); a MAD of 0 keeps all; a null key part makes the fine stratum fall back."""
    part = lambda keys: F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("NA")) for k in keys])
    known = F.lit(True)
    for k in fine:
        known = known & F.col(k).isNotNull()
    size = F.count("*").over(Window.partitionBy(*fine))
    x = df.withColumn("__s", F.when(known & (size >= least), F.concat(F.lit("f|"), part(fine))).otherwise(F.concat(F.lit("c|"), part(coarse)))).withColumn("__l", F.ln(value))
    w = Window.partitionBy("__s")
    x = x.withColumn("__d", F.abs(F.col("__l") - F.median("__l").over(w)))
    x = x.withColumn("__mad", F.median("__d").over(w))
    return x.where((F.col("__mad") <= 0) | (F.col("__d") <= z * 1.4826 * F.col("__mad"))).drop("__s", "__l", "__d", "__mad")




def impute(df: DataFrame, value: str, levels: Sequence[Sequence[str]], raw: bool = False) -> DataFrame:
    """Missing values by group medians, finest level first; raw: all medians are of the original values."""
    out = df.withColumn("__raw", F.col(value))
    for keys in levels:
        middle = F.median("__raw" if raw else value)
        if keys:
            out = out.withColumn(value, F.coalesce(F.col(value), middle.over(Window.partitionBy(*keys))))
        else:  # one row for all, not a window over them
            out = out.crossJoin(F.broadcast(out.agg(middle.alias("__all")))).withColumn(value, F.coalesce(F.col(value), "__all")).drop("__all")
    return out.drop("__raw")


def raked(value: Column, target: Column, keys: Sequence[str]) -> Column:
    """value scaled so that its group sums to target."""
    return value * target / F.sum(value).over(Window.partitionBy(*keys))


def group_mean(value: Column, weight: Column, keys: Sequence[str]) -> Column:
    w = Window.partitionBy(*keys)
    ok = F.when(weight > 0, weight).otherwise(F.lit(1.0))
    return F.sum(value * ok).over(w) / F.sum(F.when(value.isNotNull(), ok)).over(w)


def deviation(value: Column, weight: Column, keys: Sequence[str]) -> Column:
    """value less its group's weighted mean; the weights of missing values stay in the denominator."""
    w = Window.partitionBy(*keys)
    return value - F.coalesce(F.sum(weight * value).over(w), F.lit(0.0)) / F.sum(weight).over(w)


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """The least value at which the cumulative weight reaches half."""
    one = df.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*keys)
    x = one.withColumn("__c", F.sum("__w").over(w.orderBy(value))).withColumn("__t", F.sum("__w").over(w))
    return x.where(F.col("__c") >= F.col("__t") / 2).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def lorenz(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Gini by group: 1 - 2 * area under the cumulative share over evenly spaced 0..1 (trapezoids)."""
    w = Window.partitionBy(*keys).orderBy(value)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    x = df.withColumn("__s", F.sum(value).over(run) / F.sum(value).over(all_)).withColumn("__n", F.count("*").over(all_))
    x = x.withColumn("__p", F.lag("__s").over(w))
    area = F.sum((F.col("__s") + F.col("__p")) / 2) / (F.max("__n") - 1)
    return x.groupBy(*keys).agg((1 - 2 * area).alias("gini"))


def binned_means(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Means of x and y by quantile bin of x (the last edge belongs to the last bin); the edges are one row."""
    q = [i / bins for i in range(bins + 1)]
    edges = df.agg(F.percentile(x, F.array(*map(F.lit, q))).alias("__e"))
    at = F.least(F.size(F.filter("__e", lambda e: e <= F.col(x))), F.lit(bins))
    return df.crossJoin(F.broadcast(edges)).groupBy(at.alias("bin")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("n"))


def trailing_mean(df: DataFrame, keys: Sequence[str], index: str, value: str, end: int, width: int) -> DataFrame:
    return df.where(F.col(index).between(end - width + 1, end)).groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def growth_factor(df: DataFrame, year: str, value: str, base: int, target: int) -> float:
    """Median of target year over median of base; without target the compounded growth of up to three prior years."""
    m = {r[0]: r[1] for r in df.groupBy(year).agg(F.median(value)).collect()}
    if target in m and base in m:
        return m[target] / m[base]
    years = sorted(y for y in m if y <= base)[-4:]
    rate = (m[years[-1]] / m[years[0]]) ** (1 / (years[-1] - years[0])) if len(years) > 1 else 1.0
    return rate ** (target - base)


def speed_profile(ways: DataFrame, defaults: DataFrame, least_m: float = 30_000.0) -> DataFrame:
    """(road, urban, kmh): length-weighted median of tagged speeds, to the next 5 km/h (half to even), default where too little is tagged.

    ways: road, urban, kmh (null: untagged), metres; defaults: road, urban, kmh.
    """
    tagged = ways.where("kmh IS NOT NULL")
    keys = ["road", "urban"]
    found = weighted_median(tagged, keys, "kmh", "metres").join(tagged.groupBy(*keys).agg(F.sum("metres").alias("__m")), keys).where(F.col("__m") >= least_m)
    own = F.bround(F.col("weighted_median") / 5) * 5
    return defaults.join(found, keys, "left").select(*keys, F.coalesce(own, F.col("kmh")).cast("double").alias("kmh"), F.col("weighted_median").isNotNull().alias("measured"))


def calibration_factor(df: DataFrame, key: str, ratio: str, least: int = 100, lo: float = 0.3, hi: float = 1.2, fallback: float = 1.0) -> DataFrame:
    """(key, n, k): median ratio of a group with enough ratios strictly inside lo..hi, else the one over all groups, else the fallback."""
    ok = df.where((F.col(ratio) > lo) & (F.col(ratio) < hi) & ~F.isnan(ratio))
    per = ok.groupBy(key).agg(F.count("*").alias("n"), F.median(ratio).alias("__m"))
    whole = ok.agg(F.when(F.count("*") >= least, F.median(ratio)).alias("__all"))
    out = df.select(key).distinct().join(per, key, "left").crossJoin(F.broadcast(whole))  # one row
    return out.select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(F.when(F.col("n") >= least, F.col("__m")), F.col("__all"), F.lit(fallback)).alias("k"))


def extrapolated(anchor: DataFrame, growth: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Values scaled by the growth (key, growth) of their group; groups without one grow as the median group."""
    mid = growth.agg(F.median("growth").alias("__mid"))
    x = anchor.join(growth, key, "left").crossJoin(F.broadcast(mid)).withColumn("__g", F.coalesce("growth", "__mid", F.lit(1.0)))
    return x.withColumns({v: F.col(v) * F.col("__g") for v in values}).drop("growth", "__mid", "__g")


def diverging_limits(df: DataFrame, value: str) -> DataFrame:
    """(lo, hi): limits of equal size about zero, 1 where all values are zero or missing."""
    top = F.max(F.when(~F.isnan(value), F.abs(value)))
    return df.agg(F.coalesce(F.when(top > 0, top), F.lit(1.0)).alias("hi")).select((-F.col("hi")).alias("lo"), "hi")


def natural_breaks(df: DataFrame, value: str, k: int = 7) -> DataFrame:
    """(class, upper, n): classes with the least squared deviation from their means (Fisher-Jenks), exact for any number of values.

    Equal values are counted first; one task gets the distinct ones and places the breaks in O(k d log d), as
    the best last break never moves back when values are added.  Null and NaN are left out.
    """
    x = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(value).cast("double").alias("v"))
    counts = x.groupBy("v").agg(F.count("*").alias("n"))

    def place(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("v")
        n, v = pdf["n"].to_numpy(float), pdf["v"].to_numpy(float)
        m = v - np.average(v, weights=n)
        cn, cs, cq = (np.concatenate([[0], np.cumsum(a)]) for a in (n, n * m, n * m * m))
        size, classes = len(n), min(k, len(n))
        best, cut = np.concatenate([[0], np.full(size, np.inf)]), np.zeros((classes + 1, size + 1), dtype=int)
        for c in range(1, classes + 1):
            new = np.full(size + 1, np.inf)
            # all j of jl..jr, whose best break lies in il..ir: the middle one is settled and halves the rest
            jl, jr, il, ir = (np.array([a]) for a in (c, size, c - 1, size - 1))
            while len(jl):
                mid = (jl + jr) // 2
                many = np.minimum(ir, mid - 1) - il + 1
                first = np.cumsum(many) - many
                own = np.repeat(np.arange(len(mid)), many)
                i, j = np.arange(len(own)) - first[own] + il[own], mid[own]
                cost = best[i] + (cq[j] - cq[i]) - (cs[j] - cs[i]) ** 2 / (cn[j] - cn[i])
                low = np.minimum.reduceat(cost, first)
                hit = np.flatnonzero(cost == low[own])
                pick = i[hit[np.unique(own[hit], return_index=True)[1]]]
                new[mid], cut[c, mid] = low, pick
                jl, jr, il, ir = (np.concatenate(a) for a in ((jl, mid + 1), (mid - 1, jr), (il, pick), (pick, ir)))
                live = jl <= jr
                jl, jr, il, ir = jl[live], jr[live], il[live], ir[live]
            best = new
        ends, j = [], size
        for c in range(classes, 0, -1):
            ends.append((c, float(v[j - 1]), int(cn[j] - cn[cut[c, j]])))
            j = cut[c, j]
        return pd.DataFrame(ends[::-1], columns=["class", "upper", "n"])

    return counts.withColumn("one", F.lit("")).groupBy("one").applyInPandas(place, "class int, upper double, n long")
