"""Tables of reports and checks: comparisons between runs, coverage, roll-ups, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_totals(ways: DataFrame, road: str, metres: str, tagged: str) -> DataFrame:
    """(road, total, tagged_share): length by class and the share of it that states a speed."""
    return ways.groupBy(road).agg(F.sum(metres).alias("total"), (F.sum(F.when(F.col(tagged), F.col(metres)).otherwise(0.0)) / F.sum(metres)).alias("tagged_share"))


def parts_of(df: DataFrame, key: str, only: Sequence | None = None) -> DataFrame:
    """The distinct values of a partition key in order, null last; only: those alone."""
    x = df.select(key).distinct()
    return (x.where(F.col(key).isin(*only)) if only else x).orderBy(F.asc_nulls_last(key))


def within_radius(points: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """Points (x, y) within a radius with their distance, the nearest first; the square around is looked up before."""
    box = points.where(F.col("x").between(x - radius, x + radius) & F.col("y").between(y - radius, y + radius))
    d = F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2)
    return box.withColumn("distance", d).where(F.col("distance") <= radius).orderBy("distance")


def aligned_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Every pair of a with the values of both runs; what b lacks is null."""
    return a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), list(keys), "left")


def difference(runs: DataFrame) -> DataFrame:
    """One row on b - a where both are known: pairs, mean, median, least, most, share that fell."""
    d = F.col("b") - F.col("a")
    x = runs.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", d)
    return x.agg(F.count("*").alias("pairs"), F.avg("d").alias("mean"), F.median("d").alias("median"), F.min("d").alias("least"), F.max("d").alias("most"), F.avg(F.when(F.col("d") <= 0, 1.0).otherwise(0.0)).alias("fell"))


def growth(end: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """(key, growth, log_change) of keys that both years have."""
    x = end.select(key, F.col(value).alias("e")).join(base.select(key, F.col(value).alias("b")), key).where("b > 0 AND e > 0")
    return x.select(key, (F.col("e") / F.col("b") - 1).alias("growth"), F.ln(F.col("e") / F.col("b")).alias("log_change"))


def rolled_up(df: DataFrame, code: str, digits: int, sums: Sequence[str], mean: str, weight: str) -> DataFrame:
    """Values by the first digits of a code: sums, and a weighted mean."""
    return df.groupBy(F.substring(code, 1, digits).alias("code")).agg(*[F.sum(c).alias(c) for c in sums], (F.sum(F.col(mean) * F.col(weight)) / F.sum(weight)).alias(mean))


def boxes(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles of a value by class."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(by).agg(F.count(value).alias("n"), q(0.25).alias("q1"), F.median(value).alias("median"), q(0.75).alias("q3"))


def inventory(df: DataFrame, by: str) -> DataFrame:
    """Rows by value, missing ones by name, the most first."""
    return df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("(missing)")).alias(by)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(rate, n): how often two codes agree where both are known."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return x.agg(F.avg(F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)).alias("rate"), F.count("*").alias("n"))


def frame_gates(df: DataFrame, frame: DataFrame, key: str, value: str, weight: str, group: str, anchor: DataFrame) -> DataFrame:
    """(check, passed, value): every unit once, no value missing, weighted means meet the anchors (group, anchor)."""
    once = df.groupBy(key).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, 1).otherwise(0)), F.lit(0)).alias("v"))
    lost = frame.select(key).join(df.select(key), key, "left_anti").agg(F.count("*").alias("v"))
    none = df.agg(F.coalesce(F.sum(F.col(value).isNull().cast("long")), F.lit(0)).alias("v"))
    mean = df.groupBy(group).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("m")).join(anchor, group)
    far = mean.agg(F.max(F.abs(F.col("m") / F.col("anchor") - 1)).alias("v"))
    rows = [("unique", once, 0.0), ("complete", lost, 0.0), ("known", none, 0.0), ("anchored", far, 1e-6)]
    out = None
    for name, x, most in rows:
        x = x.select(F.lit(name).alias("check"), (F.col("v") <= most).alias("passed"), F.col("v").cast("double").alias("value"))
        out = x if out is None else out.unionByName(x)
    return out


def balance(trade: DataFrame, places: DataFrame) -> DataFrame:
    """(code, income, expenditure, gap): what a place earns against what is spent on its goods.

    trade (n, i, x): n's weight on goods of i, shares are of the row; places (code, w, l, v, r).
    """
    share = trade.join(trade.groupBy("n").agg(F.sum("x").alias("t")), "n")
    spend = places.select(F.col("code").alias("n"), (F.col("v") * F.col("r")).alias("s"))
    got = share.join(spend, "n").groupBy(F.col("i").alias("code")).agg(F.sum(F.col("x") / F.col("t") * F.col("s")).alias("expenditure"))
    out = places.select("code", (F.col("w") * F.col("l")).alias("income")).join(got, "code")
    return out.withColumn("gap", F.abs(F.col("income") - F.col("expenditure")))


def solve_order(needs: dict[int, int | None]) -> list[int]:
    """Years in an order in which each comes after the one it borrows from."""
    out: list[int] = []
    for year in sorted(needs):
        chain = []
        while year is not None and year not in out:
            if year in chain:
                raise ValueError(f"years borrow from one another: {chain}")
            chain.append(year)
            year = needs.get(year)
        out += chain[::-1]
    return out


def levels(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Logs of positive values, as maps show them; others are null."""
    return df.select(key, *[F.when(F.col(c) > 0, F.ln(c)).alias(f"log_{c}") for c in values])


def own_share(flows: DataFrame) -> DataFrame:
    """(n, share) of those of each residence n who stay (n, i, value)."""
    return flows.groupBy("n").agg((F.sum(F.when(F.col("n") == F.col("i"), F.col("value")).otherwise(0.0)) / F.sum("value")).alias("share"))


def log_changes(a: DataFrame, b: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """d_value = ln b - ln a on the keys of both runs; null where either is not positive."""
    x = a.select(key, *[F.col(c).alias(f"a_{c}") for c in values]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in values]), key)
    return x.select(key, *[F.when((F.col(f"a_{c}") > 0) & (F.col(f"b_{c}") > 0), F.ln(f"b_{c}") - F.ln(f"a_{c}")).alias(f"d_{c}") for c in values])


def log_correlation(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(pairs, rho) of the logs of two runs over keys where both are positive."""
    x = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key).where("x > 0 AND y > 0")
    return x.agg(F.count("*").alias("pairs"), F.corr(F.ln("x"), F.ln("y")).alias("rho"))


def from_origin(runs: DataFrame, origin) -> DataFrame:
    """(i, a, b, change) from one origin to every destination of aligned runs (n, i, a, b), the nearest first."""
    return runs.where(F.col("n") == F.lit(origin)).select("i", "a", "b", (F.col("b") - F.col("a")).alias("change")).orderBy("a", "i")
