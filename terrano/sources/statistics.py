"""Wide tables of official statistics as long ones: headers hold `;`-joined dimensions, empty and zero cells are suppressed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..operators.relational import keep_first
from .tables import wide_csv

#: Names of months, and of the two concepts of a wage.
MONTHS = "styczeń luty marzec kwiecień maj czerwiec lipiec sierpień wrzesień październik listopad grudzień".split()
CONCEPTS = {"wg siedziby podmiotu": "workplace", "wg miejsca zamieszkania": "residence"}
WORKING_AGE = "w wieku produkcyjnym"


def _positive(c):
    return F.when(c > 0, c)


def _lookup(pairs: dict):
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _month(c):
    return F.try_element_at(_lookup({m: i + 1 for i, m in enumerate(MONTHS)}), c)


def _counties(df: DataFrame) -> DataFrame:
    return df.where(codes.is_county(F.col("kod")) & (F.substring("kod", 1, 2) != "00")).withColumn("powiat", F.substring("kod", 1, 4))


def _communes(df: DataFrame) -> DataFrame:
    return df.where(codes.is_whole_commune(F.col("kod"))).withColumn("code6", codes.code6(F.col("kod")))


def price_levels(spark: SparkSession, medians: str, means: str) -> DataFrame:
    """(powiat, nazwa, market, size, year, median, mean): both files joined whole, county rows only."""
    dims, key = ["market", "size", "year", "unit"], ["kod", "nazwa", "market", "size", "year"]
    one = lambda path, name: wide_csv(spark, path, dims, "[zł]").where("value IS NOT NULL").select(*key, F.col("value").alias(name))
    both = one(medians, "median").join(one(means, "mean"), key, "full")
    return _counties(both).select("powiat", "nazwa", "market", "size", F.col("year").cast("int").alias("year"), "median", "mean")


def housing_stock(spark: SparkSession, path: str) -> DataFrame:
    """(gmina, year, dwellings) of whole communes."""
    x = wide_csv(spark, path, ["total", "kind", "year", "unit"]).where("kind LIKE '%mieszkania%' AND value IS NOT NULL")
    return _communes(x).groupBy(F.col("kod").alias("gmina"), F.col("year").cast("int").alias("year")).agg(F.sum("value").alias("dwellings"))


def county_wages(spark: SparkSession, path: str) -> DataFrame:
    """(powiat, year, wage); what is not positive is missing."""
    x = _counties(wide_csv(spark, path, ["total", "year", "unit"], "[zł]"))
    return x.select("powiat", F.col("year").cast("int").alias("year"), _positive(F.col("value")).alias("wage"))


def commune_wages(spark: SparkSession, path: str) -> DataFrame:
    """(code6, nazwa, concept, year, month, wage); months and concepts of other names are left out."""
    x = _communes(wide_csv(spark, path, ["month", "concept", "total", "year", "unit"], "[zł]"))
    x = x.select("code6", "nazwa", F.try_element_at(_lookup(CONCEPTS), F.col("concept")).alias("concept"), F.col("year").cast("int").alias("year"), _month(F.col("month")).alias("month"), _positive(F.col("value")).alias("wage"))
    return x.where("concept IS NOT NULL AND month IS NOT NULL")


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """(code6, year, emp): employment by workplace, null where every part is."""
    x = _communes(wide_csv(spark, path, ["total", "year", "unit"], "[osoba]"))
    return x.groupBy("code6", F.col("year").cast("int").alias("year")).agg(F.sum("value").alias("emp"))


def employed_residents(spark: SparkSession, path: str) -> DataFrame:
    """(code6, year, month, emp): employment by residence."""
    x = _communes(wide_csv(spark, path, ["month", "kind", "total", "year", "unit"], "[osoba]"))
    return x.select("code6", F.col("year").cast("int").alias("year"), _month(F.col("month")).alias("month"), F.col("value").alias("emp")).where("month IS NOT NULL")


def working_age(spark: SparkSession, path: str) -> DataFrame:
    """(code6, workage): one row for each commune, null where the column says nothing."""
    x = _communes(wide_csv(spark, path, ["label", "sex", "year", "unit"], "[osoba]"))
    x = x.groupBy("kod", "code6").agg(F.max(F.when(F.col("label") == WORKING_AGE, F.col("value"))).alias("workage"))
    return keep_first(x, ["code6"], [F.col("kod")]).select("code6", "workage")


def earners(spark: SparkSession, path: str) -> DataFrame:
    """(powiat, income_earners): all columns about own work together, null where none says anything."""
    x = _counties(wide_csv(spark, path, ["label", "sex", "year", "unit"], "[osoba]"))
    return x.groupBy("powiat").agg(F.sum(F.when(F.lower("label").rlike("praca|pracy"), F.col("value"))).alias("income_earners"))
