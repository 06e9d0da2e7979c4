"""Connected components of a link table, distributed: alternating large-star and small-star steps.

Every step is an aggregation (partial, so hubs reach a reducer as one row a task) and an
equi-join that adaptive execution splits; each step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v).  Large: larger neighbours go to the least of the neighbourhood; small: the others do."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the least node reachable; nodes without a link to another are left out."""
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct())
    mark = None
    while True:
        step = stored(_star(_star(edges, True), False))
        now = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(links.sparkSession, edges)
        edges = step
        if now == mark:
            break
        mark = now
    # every node but the roots is now linked to its root alone
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
