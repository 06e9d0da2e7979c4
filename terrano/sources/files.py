"""Sources Spark has no reader for: GeoPackage tables, matrix bundles, spreadsheets, tiles of features.

Bundles and sheets are read through binaryFile, so from any store Spark reads; each file must fit
one row (2 GB).  SQLite needs a real file, so a GeoPackage's path must be mounted on all executors.
"""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, first: int, stop: int):
        super().__init__((first, stop))


class _Features(DataSourceReader):
    """One partition for each range of `chunk` feature ids; the condition runs inside SQLite."""

    def __init__(self, options: dict[str, str]):
        self._o = {"chunk": "200000", "where": "1", "geom": "geom", "fid": "fid", "columns": "", **options}

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self._o['path']}?mode=ro", uri=True)

    def partitions(self) -> Sequence[_Range]:
        con, step = self._open(), int(self._o["chunk"])
        try:
            fid = _quoted(self._o["fid"])
            lo, hi = con.execute(f"SELECT min({fid}), max({fid}) FROM {_quoted(self._o['table'])}").fetchone()
        finally:
            con.close()
        return [_Range(0, 0)] if lo is None else [_Range(a, min(a + step, hi + 1)) for a in range(lo, hi + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = [c for c in self._o["columns"].split(",") if c]
        fid, geom = _quoted(self._o["fid"]), _quoted(self._o["geom"])
        listed = "".join(f"CAST({_quoted(c)} AS TEXT), " for c in names)
        con = self._open()
        try:
            yield from con.execute(f"SELECT {fid}, {listed}{geom} FROM {_quoted(self._o['table'])} WHERE {fid} >= ? AND {fid} < ? AND ({self._o['where']})", partition.value)
        finally:
            con.close()


class GeoPackage(DataSource):
    """format("geopackage"): fid, the listed columns as strings, geom as its blob. Options: path, table, columns, where, chunk, fid, geom."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        names = [c for c in self.options.get("columns", "").split(",") if c]
        return "fid long, " + "".join(f"`{c}` string, " for c in names) + "geom binary"

    def reader(self, schema) -> _Features:
        return _Features(dict(self.options))


def geopackage(spark: SparkSession, path: str, table: str, columns: Sequence[str], where: str = "1", chunk: int = 200_000) -> DataFrame:
    """The features of a layer, in parallel by ranges of feature ids; an empty layer gives no rows."""
    spark.dataSource.register(GeoPackage)
    return spark.read.format("geopackage").options(table=table, columns=",".join(columns), where=where, chunk=str(chunk)).load(path)


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def matrix_bundle(spark: SparkSession, path: str, value: str = "tau", rows: str = "ids", cols: str | None = None) -> DataFrame:
    """(n, i, value) of the square or rectangular array in an NPZ bundle, labelled by its arrays of ids; missing cells are left out."""
    def cells(it):
        for batch in it:
            for blob in batch.column("content"):
                with np.load(io.BytesIO(blob.as_py()), allow_pickle=False) as z:
                    m, a, b = z[value], z[rows].astype(str), z[cols or rows].astype(str)
                if m.shape != (len(a), len(b)):
                    raise ValueError(f"array {value} has shape {m.shape}, its labels {(len(a), len(b))}")
                labels = pa.array(b)
                for k, row in enumerate(m.astype(float)):
                    out = pa.RecordBatch.from_arrays([pa.array([a[k]] * len(b), pa.string()), labels.cast(pa.string()), pa.array(row)], names=["n", "i", "value"])
                    yield out.filter(pa.array(np.isfinite(row)))

    return _contents(spark, path).mapInArrow(cells, "n string, i string, value double")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    at = 0
    for c in ref:
        if not c.isalpha():
            break
        at = at * 26 + ord(c.upper()) - 64
    return at - 1


def _cells(blob: bytes, sheet: str | None) -> Iterator[dict[int, str]]:
    """The rows of a worksheet (the first, if none is named) as {column: text}."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        names, shared = set(z.namelist()), []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in x.iter(f"{_SHEET}t")) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        book = list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"))
        found = next((x for x in book if sheet is None or x.get("name") == sheet), None)
        if found is None:
            raise ValueError(f"no sheet {sheet!r}; there are {[x.get('name') for x in book]}")
        target = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}[found.get(_REL)]
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_SHEET}row":
                    continue
                out = {}
                for k, c in enumerate(row.iter(f"{_SHEET}c")):
                    v = c.find(f"{_SHEET}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                    if text is not None:
                        out[_column(c.get("r")) if c.get("r") else k] = shared[int(text)] if c.get("t") == "s" else text
                yield out
                row.clear()


def spreadsheet(spark: SparkSession, path: str, columns: dict[str, int], sheet: str | None = None, skip: int = 0) -> DataFrame:
    """Columns of an .xlsx worksheet, by position, as strings; rows without any of them are left out."""
    names, at = list(columns), list(columns.values())

    def read(it):
        for batch in it:
            for blob in batch.column("content"):
                rows = [[r.get(a) for a in at] for k, r in enumerate(_cells(blob.as_py(), sheet)) if k >= skip]
                rows = [r for r in rows if any(x is not None for x in r)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names=names)

    return _contents(spark, path).mapInArrow(read, ", ".join(f"`{n}` string" for n in names))


def merged_tiles(tiles: Sequence[DataFrame], key: str = "gml_id") -> DataFrame:
    """Features of all tiles once each, with the first tile's columns; a feature on a border comes from the earliest tile.

    Columns that a tile lacks are null there, columns only later tiles have are left out; rows without a key all stay.
    """
    names, whole = tiles[0].columns, None
    for k, t in enumerate(tiles):
        t = t.select(*[c for c in t.columns if c in names]).withColumn("__tile", F.lit(k))
        whole = t if whole is None else whole.unionByName(t, allowMissingColumns=True)
    kept = whole.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*names), "__tile").alias("__row")).select("__row.*")
    return kept.unionByName(whole.where(F.col(key).isNull()).select(*names))
