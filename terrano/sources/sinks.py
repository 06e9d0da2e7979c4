"""Outputs that can be written again: by partition, resumable, with a manifest beside them; and run settings."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_index(df: DataFrame, path: str, columns: Sequence[str], key: str) -> None:
    """CSV and Parquet of the columns, sorted by key over all files."""
    out = df.select(*columns).orderBy(key)
    out.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    out.write.mode("overwrite").parquet(f"{path}/parquet")


def write_tidy(years: dict[int, DataFrame], walk: DataFrame, diagnostics: dict, path: str) -> None:
    """A CSV for each year, the crosswalk, and the diagnostics as one JSON line."""
    for year, df in years.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/year={year}")
    walk.write.mode("overwrite").option("header", True).csv(f"{path}/crosswalk")
    line = json.dumps(diagnostics, sort_keys=True)
    walk.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/diagnostics")


def write_parts(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Parquet by partition; what is written again replaces its own partitions only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_matrix(od: DataFrame, path: str, value: str, meta: dict) -> None:
    """A long matrix (n, i, value) as Parquet with a JSON line about it."""
    od.select("n", "i", value).write.mode("overwrite").parquet(f"{path}/matrix")
    od.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def wide_matrix(od: DataFrame, value: str, codes: Sequence) -> DataFrame:
    """A matrix with a column for each code; for small frames."""
    return od.groupBy("n").pivot("i", list(codes)).agg(F.first(value))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def resumed(spark: SparkSession, parts: Iterable, make: Callable[[object], DataFrame], path: str) -> list:
    """Writes the parts that are not written yet and returns their names: Spark marks a finished folder, so a run
    that broke off leaves no mark and its part is made again."""
    made = []
    for part in parts:
        out = f"{path}/part={part}"
        if not _exists(spark, f"{out}/_SUCCESS"):
            make(part).write.mode("overwrite").parquet(out)
            made.append(part)
    return made


@dataclass
class Settings:
    """Parameters of a run; root: an argument, else the file's, else the folder of the file."""

    root: str = "."
    years: list = field(default_factory=lambda: [2011, 2021])
    alpha: float = 0.70
    epsi: float = 4.60
    mu: float = 0.47
    sigma: float = 4.0
    nu: float = 0.05
    delta: float = 0.38
    psi: float = 0.42

    @classmethod
    def read(cls, path: str, root: str | None = None) -> Settings:
        """Settings of a JSON file, checked; unknown names raise an error."""
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
        lost = set(got) - {x.name for x in fields(cls)}
        if lost:
            raise ValueError(f"unknown settings: {sorted(lost)}")
        out = cls(**got)
        out.root = root or got.get("root") or path.rpartition("/")[0] or "."
        if not (0 < out.alpha < 1 and out.epsi > 1 and out.sigma > 1 and out.years):
            raise ValueError("settings out of range")
        return out
