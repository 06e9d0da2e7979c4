"""Spatial operators without a geometry library: rings are arrays of struct<x, y>."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _turns(ring: Column) -> Column:
    """Cross products of successive corners."""
    ahead = F.concat(F.slice(ring, 2, 1 << 30), F.slice(ring, 1, 1))
    return F.zip_with(ring, ahead, lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("k"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))


def _total(c: Column, f) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, v: s + f(v))


def ring_area(ring: Column) -> Column:
    return _total(_turns(ring), lambda v: v["k"]) / 2


def ring_centroid(ring: Column) -> Column:
    """Shoelace centroid of the outer ring; fewer than three corners or no area: the corners' mean."""
    a = ring_area(ring)
    mean = F.struct((_total(ring, lambda p: p["x"]) / F.size(ring)).alias("x"), (_total(ring, lambda p: p["y"]) / F.size(ring)).alias("y"))
    t = _turns(ring)
    c = F.struct((_total(t, lambda v: v["x"] * v["k"]) / (6 * a)).alias("x"), (_total(t, lambda v: v["y"] * v["k"]) / (6 * a)).alias("y"))
    return F.when((F.size(ring) < 3) | (F.abs(a) < 1e-9), mean).otherwise(c)


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting."""
    ahead = F.concat(F.slice(ring, 2, 1 << 30), F.slice(ring, 1, 1))
    crossed = F.zip_with(ring, ahead, lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0))
    return F.aggregate(crossed, F.lit(0), lambda s, v: s + v) % 2 == 1


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def points_in_areas(points: DataFrame, areas: DataFrame, size: float, how: str = "left") -> DataFrame:
    """Each point (pid, x, y) with the area (aid, ring) that holds it, the least aid at borders: an equi-join on grid cells, then ray casting."""
    box = areas.withColumns({"x0": F.array_min(F.transform("ring", lambda p: p["x"])), "x1": F.array_max(F.transform("ring", lambda p: p["x"])), "y0": F.array_min(F.transform("ring", lambda p: p["y"])), "y1": F.array_max(F.transform("ring", lambda p: p["y"]))})
    tiles = box.select("*", F.explode(_cells(F.col("x0"), F.col("x1"), size)).alias("cx")).select("*", F.explode(_cells(F.col("y0"), F.col("y1"), size)).alias("cy"))
    p = points.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    hit = p.join(tiles, ["cx", "cy"]).where((F.col("x").between(F.col("x0"), F.col("x1"))) & F.col("y").between(F.col("y0"), F.col("y1")) & inside(F.col("ring"), F.col("x"), F.col("y")))
    hit = hit.groupBy("pid").agg(F.min("aid").alias("aid"))
    return points.join(hit, "pid", how)


def nearest_within(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """Each left point (lid, x, y) with the nearest right point (rid, x, y) within reach, ties to the least rid: an equi-join on 3x3 grid cells."""
    cell = lambda c: F.floor(F.col(c) / reach)
    a = left.select("lid", "x", "y", F.explode(F.sequence(cell("x") - 1, cell("x") + 1)).alias("cx"), cell("y").alias("gy")).select("lid", "x", "y", "cx", F.explode(F.sequence(F.col("gy") - 1, F.col("gy") + 1)).alias("cy"))
    b = right.select("rid", F.col("x").alias("rx"), F.col("y").alias("ry"), cell("x").alias("cx"), cell("y").alias("cy"))
    x = a.join(b, ["cx", "cy"]).withColumn("dist", F.sqrt((F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2)).where(F.col("dist") <= reach)
    return x.groupBy("lid").agg(F.min(F.struct("dist", "rid")).alias("m")).select("lid", F.col("m.rid").alias("rid"), F.col("m.dist").alias("dist"))


def best_overlap(left: DataFrame, right: DataFrame, size: float, least: float = 0.10) -> DataFrame:
    """Each left box (lid, x0, y0, x1, y1) with the right box (rid, ...) of the largest overlap, if it covers `least` of the left one."""
    def tiles(df, k):
        df = df.select(k, *[F.col(c).alias(f"{k}_{c}") for c in ("x0", "y0", "x1", "y1")])
        df = df.withColumn("cx", F.explode(_cells(F.col(f"{k}_x0"), F.col(f"{k}_x1"), size)))
        return df.withColumn("cy", F.explode(_cells(F.col(f"{k}_y0"), F.col(f"{k}_y1"), size)))
    w = F.least("lid_x1", "rid_x1") - F.greatest("lid_x0", "rid_x0")
    h = F.least("lid_y1", "rid_y1") - F.greatest("lid_y0", "rid_y0")
    x = tiles(left, "lid").join(tiles(right, "rid"), ["cx", "cy"]).withColumn("w", w).withColumn("h", h).where("w > 0 AND h > 0")
    x = x.withColumn("share", F.col("w") * F.col("h") / ((F.col("lid_x1") - F.col("lid_x0")) * (F.col("lid_y1") - F.col("lid_y0"))))
    x = x.select("lid", "rid", "share").distinct()
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy("lid").orderBy(F.desc("share"), "rid")))
    return x.where("rn = 1").where(F.col("share") >= least).select("lid", "rid", "share")


def weighted_centroid(df: DataFrame, key: str, weight: str) -> DataFrame:
    """Weighted mean point by key; keys without weight get the plain mean and weight 0."""
    w = F.sum(weight)
    at = lambda c: F.when(w > 0, F.sum(F.col(c) * F.col(weight)) / w).otherwise(F.avg(c))
    return df.groupBy(key).agg(at("x").alias("x"), at("y").alias("y"), F.coalesce(w, F.lit(0)).alias("weight"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    r = math.pi / 180
    a = F.sin((lat2 - lat1) * r / 2) ** 2 + F.cos(lat1 * r) * F.cos(lat2 * r) * F.sin((lon2 - lon1) * r / 2) ** 2
    return 2 * 6371008.8 * F.asin(F.sqrt(a))


def ground_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the WGS84 ellipsoid by its two radii at the middle latitude: within one part in a million up to 30 km."""
    flat = 1 / 298.257223563
    e2 = flat * (2 - flat)
    mid = F.radians((lat1 + lat2) / 2)
    w = 1 - e2 * F.sin(mid) ** 2
    north = 6378137.0 * (1 - e2) / (w * F.sqrt(w)) * F.radians(lat2 - lat1)
    east = 6378137.0 / F.sqrt(w) * F.cos(mid) * F.radians(lon2 - lon1)
    return F.sqrt(north * north + east * east)


def clustered(points: DataFrame, k: int, seed: int = 0, rounds: int = 200, starts: int = 8) -> DataFrame:
    """Weighted k-means++ in each group of points (key, x, y, w); each centre is moved to its nearest member.  (key, rank, x, y, pop)."""
    def each(pdf):
        import numpy as np
        import pandas as pd

        xy, w = pdf[["x", "y"]].to_numpy(float), pdf["w"].to_numpy(float)
        if len(xy) <= k:
            o = np.argsort(-w, kind="stable")
            return pd.DataFrame({"key": pdf["key"].iloc[0], "rank": np.arange(1, len(o) + 1), "x": xy[o, 0], "y": xy[o, 1], "pop": w[o]})
        rng, best = np.random.default_rng(seed), (np.inf, None, None)
        for _ in range(starts):
            c = xy[[rng.choice(len(xy), p=w / w.sum() if w.sum() else None)]]
            while len(c) < k:
                d = ((xy[:, None] - c) ** 2).sum(2).min(1) * np.maximum(w, 1e-12)
                c = np.vstack([c, xy[rng.choice(len(xy), p=d / d.sum()) if d.sum() else rng.integers(len(xy))]])
            for _ in range(rounds):
                d = ((xy[:, None] - c) ** 2).sum(2)
                own = d.argmin(1)
                new = c.copy()
                for j in range(k):
                    m = own == j
                    new[j] = np.average(xy[m], axis=0, weights=np.maximum(w[m], 1e-12)) if m.any() else xy[(d.min(1) * w).argmax()]
                if np.allclose(new, c):
                    break
                c = new
            d = ((xy[:, None] - c) ** 2).sum(2)
            cost = float((d.min(1) * w).sum())
            if cost < best[0]:
                best = (cost, c, d.argmin(1))
        rows = []
        for j in range(k):
            m = np.flatnonzero(best[2] == j)
            if len(m):
                s = m[((xy[m] - best[1][j]) ** 2).sum(1).argmin()]
                rows.append((xy[s, 0], xy[s, 1], w[m].sum()))
        rows.sort(key=lambda r: -r[2])
        return pd.DataFrame([(pdf["key"].iloc[0], i + 1, *r) for i, r in enumerate(rows)], columns=["key", "rank", "x", "y", "pop"])

    t = points.schema["key"].dataType.simpleString()
    return points.groupBy("key").applyInPandas(each, f"key {t}, rank long, x double, y double, pop double")


def quadtree(points: DataFrame, box: tuple[float, float, float, float], most: int = 60_000, depth: int = 18, side: float = 250.0) -> DataFrame:
    """(tile, x0, y0, x1, y1, n): leaves of a quadtree over (x, y); a box splits while it holds over `most` points, is above `depth` and wider than `side`.

    Points are counted once, in cells of the deepest level; levels above are sums of their cells, so
    the plan has no pass over the points for each level.  A point on an inner edge belongs to the upper or right box;
    points outside the box are left out, empty leaves are not listed.
    """
    x0, y0, x1, y1 = box
    levels = min(depth, max(0, math.ceil(math.log2(max(x1 - x0, y1 - y0) / side)))) if side > 0 else depth
    n = 1 << levels
    cell = [F.least(F.floor((F.col(c) - a) / (b - a) * n), F.lit(n - 1)).cast("long").alias(k) for c, a, b, k in (("x", x0, x1, "cx"), ("y", y0, y1, "cy"))]
    cells = points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).groupBy(*cell).agg(F.count("*").alias("n"))
    # a cell's leaf is the shallowest box over it that need not split
    up = cells.select("cx", "cy", "n", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    side_of = F.lit(levels) - F.col("level")
    boxes = up.groupBy("level", F.expr(f"shiftright(cx, {levels} - level)").alias("bx"), F.expr(f"shiftright(cy, {levels} - level)").alias("by")).agg(F.sum("n").alias("n"))
    boxes = boxes.withColumn("ok", (F.col("n") <= most) | (side_of == 0))
    above = boxes.select((F.col("level") + 1).alias("level"), F.col("bx").alias("ux"), F.col("by").alias("uy"), F.col("ok").alias("__up"))
    leaves = boxes.where("ok").withColumns({"ux": F.expr("shiftright(bx, 1)"), "uy": F.expr("shiftright(by, 1)")}).join(above, ["level", "ux", "uy"], "left").where("__up IS NULL OR NOT __up")
    w, h = (F.lit(float(d)) / F.pow(F.lit(2.0), F.col("level")) for d in (x1 - x0, y1 - y0))
    return leaves.select(F.format_string("%d_%d_%d", "level", "bx", "by").alias("tile"), (x0 + F.col("bx") * w).alias("x0"), (y0 + F.col("by") * h).alias("y0"), (x0 + (F.col("bx") + 1) * w).alias("x1"), (y0 + (F.col("by") + 1) * h).alias("y1"), "n")


def candidate_wkt(df: DataFrame, key: str) -> DataFrame:
    """(key, n, wkt): the candidates (cand_rank, x, y) of a unit, in rank order, as a point or multipoint."""
    one = F.format_string("%.1f %.1f", "x", "y")
    x = df.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("cand_rank", one.alias("p")))).alias("c"))
    listed = F.array_join(F.transform("c", lambda c: F.concat(F.lit("("), c["p"], F.lit(")"))), ", ")
    return x.select(key, "n", F.when(F.col("n") == 1, F.concat(F.lit("POINT ("), F.col("c")[0]["p"], F.lit(")"))).otherwise(F.concat(F.lit("MULTIPOINT ("), listed, F.lit(")"))).alias("wkt"))
