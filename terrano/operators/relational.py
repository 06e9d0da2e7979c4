"""Relational idioms: ordered dedup, frame alignment, crosswalks, interpolation, pivots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_present(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first candidate column that df has, in any case."""
    have = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in have:
            return have[c.lower()]
    raise KeyError(f"none of {list(candidates)} in {df.columns}")


def keep_first(df: DataFrame, keys: Sequence, order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first under a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def aligned(frame: DataFrame, df: DataFrame, key: str, fills: dict) -> DataFrame:
    """df on the frame's keys: the first row of each key, fills where there is none."""
    one = keep_first(df, [key], [F.col(c).asc_nulls_last() for c in df.columns])
    return frame.join(one, key, "left").na.fill(fills)


def recoded_flows(flows: DataFrame, walk: DataFrame) -> DataFrame:
    """flows (res, work, count) through a crosswalk (src, dst, weight) on both ends; raises on codes without one."""
    ends = flows.select(F.col("res").alias("src")).union(flows.select("work")).distinct()
    lost = [r[0] for r in ends.join(walk.select("src").distinct(), "src", "left_anti").limit(20).collect()]
    if lost:
        raise ValueError(f"codes without a crosswalk: {lost}")
    a = walk.select(F.col("src").alias("res"), F.col("dst").alias("r"), F.col("weight").alias("wr"))
    b = walk.select(F.col("src").alias("work"), F.col("dst").alias("w"), F.col("weight").alias("ww"))
    return flows.join(a, "res").join(b, "work").groupBy(F.col("r").alias("res"), F.col("w").alias("work")).agg(F.sum(F.col("count") * F.col("wr") * F.col("ww")).alias("count"))


def harmonised(df: DataFrame, walk: DataFrame, value: str, how: str = "sum", weight: str | None = None) -> DataFrame:
    """(dst, value) through a crosswalk: weighted sum (null if all are), or mean weighted by `weight` where both are known."""
    x = df.join(walk, df["code"] == walk["src"])
    v = F.col(value)
    if how == "sum":
        return x.groupBy("dst").agg(F.sum(v * walk["weight"]).alias(value))
    w = F.col(weight) * walk["weight"]
    ok = v.isNotNull() & (w > 0)
    return x.groupBy("dst").agg((F.sum(F.when(ok, v * w)) / F.sum(F.when(ok, w))).alias(value))


def interpolated(df: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Linear between known values by position, flat beyond the ends; keys without a value vanish."""
    w = Window.partitionBy(key).orderBy(pos)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(pos))
    x = df.select("*", F.last(value, True).over(back).alias("__a"), F.last(at, True).over(back).alias("__pa"), F.first(value, True).over(ahead).alias("__b"), F.first(at, True).over(ahead).alias("__pb"))
    step = F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col(pos) - F.col("__pa")) / (F.col("__pb") - F.col("__pa"))
    v = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("__a").isNull(), F.col("__b")).when(F.col("__b").isNull(), F.col("__a")).otherwise(step)
    return x.withColumn(value, v).where(F.col(value).isNotNull()).drop("__a", "__pa", "__b", "__pb")


def counted(df: DataFrame, key: str, kind: str, kinds: Sequence) -> DataFrame:
    """Rows by key and kind, kinds as columns, 0 where there is none."""
    return df.groupBy(key).pivot(kind, list(kinds)).count().na.fill(0)


def melted(df: DataFrame, ids: Sequence[str], names: Sequence[str], keep=lambda c: True) -> DataFrame:
    """Columns whose header holds `;`-joined dimensions as rows: ids, one column a dimension, value."""
    cols = [c for c in df.columns if c not in ids and keep(c)]
    long_ = df.unpivot(list(ids), cols, "__h", "value")
    parts = F.split("__h", ";")
    return long_.select(*ids, *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)], "value")


def settled_price(df: DataFrame, comp: str, whole: str, total: str, key: str) -> Column:
    """comp if positive, else whole; still none: total, if its transaction has one row only."""
    base = F.when(F.col(comp) > 0, F.col(comp)).otherwise(F.col(whole))
    single = F.count("*").over(Window.partitionBy(key)) == 1
    return F.when(base > 0, base).when(single & (F.col(total) > 0), F.col(total))


def for_year(df: DataFrame, year_col: str, year: int) -> DataFrame:
    """Rows of the year, else of the latest earlier one, else of the earliest."""
    pick = df.agg(F.coalesce(F.max(F.when(F.col(year_col) <= year, F.col(year_col))), F.min(year_col)).alias("__y"))
    return df.join(F.broadcast(pick), df[year_col] == pick["__y"], "left_semi")


def joined_ids(c) -> Column:
    return F.array_join(F.array_sort(F.filter(F.collect_set(c), lambda x: x != "")), ";")


def outer_all(frames: Sequence[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


def crosswalk(codes: DataFrame, frame: DataFrame, specials: DataFrame) -> DataFrame:
    """(src, dst, weight): special mappings first, identity for the rest, weights of a code summing to 1.

    codes: src; frame: dst; specials: src, dst, weight.  Raises ValueError where a code leads nowhere.
    """
    src, frame = codes.select("src").where("src IS NOT NULL").distinct(), frame.select("dst").distinct()
    rest = src.join(specials.select("src"), "src", "left_anti").select("src", F.col("src").alias("dst"), F.lit(1.0).alias("weight"))
    walk = rest.unionByName(specials.select("src", "dst", F.col("weight").cast("double")).join(src, "src", "left_semi"))
    lost = walk.join(frame, "dst", "left_anti").select("src").limit(20).collect()
    if lost:
        raise ValueError(f"codes without a unit in the frame: {sorted(r.src for r in lost)}")
    return walk.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("src")))


def top_shares(df: DataFrame, key: str, rank: Sequence[Column], weight: str, take: int) -> DataFrame:
    """The first rows of each key with weights that sum to 1, equal ones where all are zero."""
    w = Window.partitionBy(key)
    x = df.withColumn("__k", F.row_number().over(w.orderBy(*rank))).where(F.col("__k") <= take)
    total = F.sum(weight).over(w)
    return x.withColumn("share", F.when(total > 0, F.col(weight) / total).otherwise(1 / F.count("*").over(w))).withColumnRenamed("__k", "rank")
