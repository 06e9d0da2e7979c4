"""Frames of place-level covariates, one row for each place of a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from .relational import first_present, keep_first
from .stats import impute


def _kinds(df: DataFrame, code: str) -> DataFrame:
    kind = codes.class_of(F.col(code))
    return df.withColumns({"kind": kind, "urban": (kind == "urban").cast("double"), "urban_rural": (kind == "urban_rural").cast("double")})


def place_covariates(places: DataFrame, land: DataFrame, anchor: DataFrame) -> DataFrame:
    """(code, county, pop, log_pop, kind, urban, urban_rural, log_land, anchor, log_anchor) of places (code, pop).

    land is (code, log_land), anchor (county, anchor), each with one row a key.  Land is filled by medians of the county, then of
    all; the anchor by those of the region, then of all; every median is of the values as they came.
    """
    x = _kinds(places.select("code", "pop"), "code").withColumns({"county": F.substring("code", 1, 4), "region": F.substring("code", 1, 2), "log_pop": F.ln(F.greatest(F.col("pop").cast("double"), F.lit(1.0)))})
    x = x.join(land.select("code", "log_land"), "code", "left").join(anchor.select("county", "anchor"), "county", "left")
    x = x.withColumn("filled", F.col("anchor").cast("double"))
    x = impute(impute(x, "filled", [["region"], []], raw=True), "log_land", [["county"], []], raw=True)
    return x.select("code", "county", "pop", "log_pop", "kind", "urban", "urban_rural", "log_land", "anchor", F.ln("filled").alias("log_anchor"))


def job_covariates(frame: DataFrame, jobs: DataFrame) -> DataFrame:
    """(code, jobs, log_jobs, urban, urban_rural) on the frame (code); missing jobs are imputed by county, region and all, one at least."""
    x = _kinds(frame.select("code"), "code").withColumns({"county": F.substring("code", 1, 4), "region": F.substring("code", 1, 2)})
    x = impute(x.join(jobs.select("code", F.col("jobs").cast("double").alias("jobs")), "code", "left"), "jobs", [["county"], ["region"], []])
    x = x.withColumn("jobs", F.when(F.col("jobs").isNotNull(), F.greatest("jobs", F.lit(1.0))))
    return x.select("code", "jobs", F.ln("jobs").alias("log_jobs"), "urban", "urban_rural")


def with_area(frame: DataFrame, polygons: DataFrame, candidates: Sequence[str] = ("teryt7", "TERYT", "JPT_KOD_JE", "kod", "gmina_teryt", "code7")) -> DataFrame:
    """The frame (code) with area_km2 of polygons (m2 and a code column, the first candidate there is); null where nothing fits."""
    try:
        key = first_present(polygons, candidates)
    except KeyError:
        return frame.withColumn("area_km2", F.lit(None).cast("double"))
    area = polygons.select(codes.code7(F.col(key)).alias("code"), (F.col("m2") / 1e6).alias("area_km2"))
    return frame.join(keep_first(area, ["code"], [F.col("area_km2").asc_nulls_last()]), "code", "left")
