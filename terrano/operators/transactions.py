"""Filters, weights and land netting of house and land transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def private_sellers(df: DataFrame, seller: str, public: Sequence[str]) -> DataFrame:
    """Rows whose seller is none of the public ones; an unknown seller stays."""
    return df.where(~F.coalesce(F.col(seller).isin(*public), F.lit(False)))


def house_filter(df: DataFrame, nearest: bool = False, floors: tuple[int, int] = (1, 5), overlap: float = 0.30, footprint: float = 40.0) -> DataFrame:
    """Built-up residential property sold whole on the free market, matched with a building: by overlap, or if asked for by nearness.

    Columns: kind, residential, match, footprint, usable, deal, share, floors, overlap.
    """
    by = F.col("match") == "overlap"
    if nearest:
        by = by | ((F.col("match") == "nearest") & (F.col("footprint") >= footprint))
    whole = (F.col("share") == "1/1") | F.col("share").isNull()
    near = (F.col("overlap") >= overlap) | (F.col("match") == "nearest")
    return df.where((F.col("kind") == "built") & (F.col("residential") == 1) & by & F.col("usable").isNotNull() & (F.col("deal") == "free") & whole & F.col("floors").between(*floors) & near)


def bridge(df: DataFrame, parcel: str, floors: tuple[int, int] = (1, 5)) -> DataFrame:
    """(parcel, usable, floors, buildings) of the residential buildings on each parcel."""
    x = df.where((F.col("residential") == 1) & F.col("usable").isNotNull() & F.col("floors").between(*floors))
    return x.groupBy(parcel).agg(F.sum("usable").alias("usable"), F.max("floors").alias("floors"), F.count("*").alias("buildings"))


def largest_first(df: DataFrame, key: str, size: str, ties: Sequence[str], first: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """One row for each key: aggregates over its rows beside values of its largest one, in one pass."""
    rank = F.struct(F.col(size), *[F.col(c) for c in ties])
    best = F.max_by(F.struct(*first), rank).alias("__b")
    return df.groupBy(key).agg(best, *[c.alias(n) for n, c in sums.items()]).select(key, "__b.*", *sums)


def marginal_houses(parcels: DataFrame, taken: DataFrame, built: DataFrame, key: str, parcel: str, ties: Sequence[str]) -> DataFrame:
    """Parcels of transactions that are not taken yet, with what is built on them; of a transaction the one with most usable area."""
    x = parcels.join(taken.select(key).distinct(), key, "left_anti").join(built, parcel)
    w = Window.partitionBy(key).orderBy(F.desc("usable"), *ties)
    return x.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def plot_in_metres(plot: Column, footprint: Column) -> Column:
    """A plot smaller than its building was written in hectares."""
    return F.when((plot > 0) & (plot < footprint), plot * 10_000).otherwise(plot)


def quality_weight(source: Column, overlap: Column, match: Column) -> Column:
    """Weight of a transaction: flats 1, marginal houses 0.7, others by overlap within 0.5..1, by nearness 0.5."""
    own = F.when(match == "nearest", 0.5).otherwise(F.least(F.greatest(F.coalesce(overlap, F.lit(0.7)), F.lit(0.5)), F.lit(1.0)))
    return F.when(source == "flat", 1.0).when(source == "marginal", 0.7).otherwise(own)


def land_filter(df: DataFrame) -> DataFrame:
    """Undeveloped land sold whole on the free market, zoned or used for housing.  Columns: kind, deal, share, zoning, use."""
    whole = (F.col("share") == "1/1") | F.col("share").isNull()
    use = F.col("zoning").contains("budownictwoMieszkaniowe") | (F.col("use") == "gruntyZabudowaneIZurbanizowane")
    return df.where((F.col("kind") == "undeveloped") & (F.col("deal") == "free") & whole & use)


def land_prices(df: DataFrame, key: str, order: Sequence[str], years: tuple[int, int], price: tuple[float, float] = (1.0, 20_000.0), ha: float = 0.02) -> DataFrame:
    """Land with its price a square metre within bounds, one row for each transaction; ha_flag tells recorded areas in hectares.

    Columns: price_whole, price_part, area, recorded, x, year.
    """
    p = F.when(F.col("price_whole") > 0, F.col("price_whole")).otherwise(F.col("price_part"))
    x = df.withColumn("land_price", p).where((F.col("land_price") > 0) & (F.col("area") > 0) & F.col("x").isNotNull())
    x = x.withColumn("ha_flag", F.col("recorded") / F.col("area") < ha).withColumn("land_ppm2", F.col("land_price") / F.col("area"))
    x = x.where(F.col("land_ppm2").between(*price) & F.col("year").between(*years))
    return x.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")


def land_surface(land: DataFrame, frame: DataFrame, levels: Sequence[str], value: str = "land_ppm2", least: int = 15) -> DataFrame:
    """frame with land_ppm2, log_land, n_land and land_level: the median of the first level that has one.

    levels are columns of both tables, finest first; the finest needs `least` rows.  After the last comes the median of all.
    """
    out = frame
    values, names = [], []
    for i, level in enumerate(levels):
        m = land.groupBy(level).agg(F.median(value).alias(f"__m{i}"), F.count("*").alias(f"__n{i}"))
        out = out.join(m, level, "left")
        v = F.col(f"__m{i}")
        values.append(F.when(F.col("__n0") >= least, v) if i == 0 else v)
        names.append(level)
    out = out.crossJoin(F.broadcast(land.agg(F.median(value).alias("__all"))))  # one row
    name = F.lit("all")
    for v, n in reversed(list(zip(values, names, strict=True))):
        name = F.when(v.isNotNull(), n).otherwise(name)
    out = out.withColumn("land_ppm2", F.coalesce(*values, "__all")).withColumn("land_level", name).withColumn("n_land", F.coalesce("__n0", F.lit(0)))
    out = out.withColumn("log_land", F.ln(F.greatest("land_ppm2", F.lit(1.0))))
    return out.drop("__all", *[f"__{a}{i}" for i in range(len(levels)) for a in "mn"])


def land_netted(houses: DataFrame, county: str, cap: float = 0.6) -> DataFrame:
    """Houses with plot_used and ppm2 of the structure: price less the land's value, at most `cap` of it, by usable area.

    Columns: price, area, plot, land_ppm2.  A missing plot is the county's median one; without a land price nothing is taken off.
    """
    plot = F.when(F.col("plot") > 0, F.col("plot")).otherwise(F.median("plot").over(Window.partitionBy(county)))
    x = houses.withColumn("plot_used", plot)
    value = F.least(F.coalesce(F.col("land_ppm2") * F.col("plot_used"), F.lit(0.0)), cap * F.col("price"))
    return x.withColumn("ppm2", (F.col("price") - value) / F.col("area"))


def house_gates(df: DataFrame, years: tuple[int, int], usable: tuple[float, float] = (25.0, 1000.0), ppm2: tuple[float, float] = (500.0, 40_000.0)) -> DataFrame:
    return df.where(F.col("ppm2").isNotNull() & ~F.isnan("ppm2") & F.col("area").between(*usable) & F.col("ppm2").between(*ppm2) & F.col("year").between(*years))


HOUSE = "tran string, unit string, source string, kind string, market string, year int, area double, price double, plot double, rooms double, floor double, ppm2 double, weight double"


def as_houses(df: DataFrame) -> DataFrame:
    """Columns of HOUSE: what a house does not have is null, and so is what df lacks."""
    fields = [f.strip().split(" ") for f in HOUSE.split(",")]
    one = lambda n, t: F.lit("house") if n == "kind" else F.lit(None).cast(t) if n in ("rooms", "floor", "ppm2") or n not in df.columns else F.col(n).cast(t)
    return df.select(*[one(n, t).alias(n) for n, t in fields])


def residential(function: Column, kind: Column) -> Column:
    return F.coalesce(F.lower(function).contains("mieszk"), F.lit(False)) | F.coalesce(F.lower(kind) == "mieszkalny", F.lit(False))


def floor_area(footprint: Column, floors: Column, k: Column | float = 1.0) -> Column:
    """Usable area by footprint and floors, times the calibrated share."""
    return footprint * floors * k
