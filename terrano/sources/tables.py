"""Sources and sinks: schemas are declared, codes stay strings."""

from __future__ import annotations

import json
import struct
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, parse
from ..operators.relational import keep_first, melted


def code_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def units(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of administrative units (WOJ;POW;GMI;RODZ;NAZWA): whole communes, one row for each six-digit code."""
    x = code_csv(spark, path, "WOJ string, POW string, GMI string, RODZ string, NAZWA string", ";").where("GMI != '' AND RODZ IN ('1', '2', '3')")
    x = x.select(F.concat(codes.padded(F.col("WOJ"), 2), codes.padded(F.col("POW"), 2), codes.padded(F.col("GMI"), 2), F.col("RODZ")).alias("code7"), F.col("NAZWA").alias("name"))
    x = x.withColumn("code6", F.substring("code7", 1, 6)).withColumn("class", codes.class_of(F.col("code7")))
    return keep_first(x, ["code6"], [F.col("code7")])


def wide_csv(spark: SparkSession, path: str, dims: Sequence[str], unit: str | None = None) -> DataFrame:
    """A wide CSV whose headers hold `;`-joined dimensions: (kod, nazwa, dims, value), suppressed cells null."""
    x = spark.read.option("header", True).option("sep", ";").option("quote", '"').csv(path)
    x = x.toDF(*[c.lstrip("﻿") for c in x.columns])
    x = x.select(*[f"`{c}`" for c in x.columns if c and not c.startswith("_c")])
    kod, nazwa = x.columns[:2]
    x = melted(x.withColumnsRenamed({kod: "kod", nazwa: "nazwa"}), ["kod", "nazwa"], dims, lambda c: unit is None or c.strip().endswith(unit))
    return x.withColumn("value", parse.reported(F.col("value")))


def decode_point(blob: bytes | None) -> tuple[float, float] | None:
    """x, y of a GeoPackage point: the header's flags give the envelope's size, WKB follows."""
    if not blob or blob[:2] != b"GP":
        return None
    at = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    return struct.unpack_from(("<" if blob[at] else ">") + "dd", blob, at + 5)


def decode_polygon(blob: bytes | None) -> tuple[float, float, float] | None:
    """Centroid of the first outer ring and the area of all parts without their holes, of a (multi)polygon blob."""
    if not blob or blob[:2] != b"GP":
        return None
    at = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]

    def rings(at):
        e = "<" if blob[at] else ">"
        kind, n = struct.unpack_from(e + "II", blob, at + 1)
        at += 9
        parts = []
        if kind % 1000 == 6:
            for _ in range(n):
                at, inner = rings(at)
                parts += inner
            return at, parts
        own = []
        for _ in range(n):
            k = struct.unpack_from(e + "I", blob, at)[0]
            flat = struct.unpack_from(e + f"{2 * k}d", blob, at + 4)
            own.append(list(zip(flat[::2], flat[1::2], strict=True)))
            at += 4 + 16 * k
        return at, [own]

    def turn(ring):
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2

    _, parts = rings(at)
    area = sum(abs(turn(p[0])) - sum(abs(turn(h)) for h in p[1:]) for p in parts)
    ring = parts[0][0]
    a = turn(ring)
    if len(ring) < 3 or abs(a) < 1e-9:
        return sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring), area
    pairs = list(zip(ring, ring[1:] + ring[:1], strict=True))
    cx = sum((p[0] + q[0]) * (p[0] * q[1] - q[0] * p[1]) for p, q in pairs) / (6 * a)
    cy = sum((p[1] + q[1]) * (p[0] * q[1] - q[0] * p[1]) for p, q in pairs) / (6 * a)
    return cx, cy, area


@F.udtf(returnType="x double, y double")
class PointRows:
    """SQL table function: the point of a GeoPackage blob."""

    def eval(self, blob: bytes):
        p = decode_point(blob)
        if p:
            yield p


def cells(df: DataFrame, left: float, top: float, res: float, box: tuple[float, float, float, float]) -> DataFrame:
    """Raster cells (row, col, value) as (population, x, y) at their centres within a box; nodata -1 counts as 0."""
    x = df.select(F.when(F.col("value") == -1, 0).otherwise(F.col("value")).cast("int").alias("population"), (left + (F.col("col") + 0.5) * res).alias("x"), (top - (F.col("row") + 0.5) * res).alias("y"))
    return x.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def write_run(sections: dict[str, DataFrame], path: str, params: dict) -> dict:
    """A run artefact: one Parquet table a section and a JSON manifest with parameters, columns and row counts."""
    spark = next(iter(sections.values())).sparkSession
    manifest = {"params": params, "sections": {}}
    for name, df in sections.items():
        df.write.mode("overwrite").parquet(f"{path}/section={name}")
        manifest["sections"][name] = {"columns": dict(df.dtypes), "rows": spark.read.parquet(f"{path}/section={name}").count()}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def latex(df: DataFrame, caption: str) -> str:
    """A small result (at most 100 rows) as a LaTeX table."""
    rows = df.limit(100).collect()
    show = lambda v: "--" if v is None or v != v else f"{v:,.3f}" if isinstance(v, float) else str(v)
    body = " \\\\\n".join(" & ".join(show(v) for v in r) for r in rows)
    return f"\\begin{{table}}\\caption{{{caption}}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{' & '.join(df.columns)} \\\\\n{body} \\\\\n\\end{{tabular}}\\end{{table}}"
