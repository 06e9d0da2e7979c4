"""Session helpers: shared storage, hashing of row identity, fixed-size sketches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Arrays of some MB go back to the system once they are freed: workers live long, and what one stage
# leaves in a heap would weigh on all that follow.  -3 is glibc's M_MMAP_THRESHOLD; other systems do without.
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL("libc.so.6").mallopt(-3, 2 << 20)

#: Rows in one Arrow batch: long texts keep a batch of a few thousand rows in the tens of MB.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that Python workers hold little text at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only where it is unset, one of our own (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or (sc._jsc.sc().getCheckpointDir().get() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="terrano-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/terrano-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes tables of stored() that are no longer needed."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        path = jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nobody holds any more: long loops would keep them all until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def empty_to_string(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def kept_out(c: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves `rest` modulo `mod`; false for a null id."""
    return F.coalesce(F.crc32(F.encode(c.cast("string"), "UTF-8")) % mod == rest, F.lit(False))


#: Parts over which equal rows are dealt to number them.
SALTS = 64


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with a column that counts those of equal keys (none null) from 0.

    Equal rows are dealt out by their place over SALTS parts, so that a row which makes up a large
    share of the table does not land in one task; each part counts on from those before it.
    """
    rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    own = [*keys, "__salt"]
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*own).agg(F.count("*").alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).where("__before > 0").drop("__c")
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*own).orderBy("__salt")))  # rows of one window are alike: any order will do
    rows = rows.join(parts, own, "left").withColumn(name, (F.col("__n") - 1 + F.coalesce("__before", F.lit(0))).cast("int"))
    return rows.drop("__salt", "__n", "__before")


BLOCK = 1 << 14


def emit_blocks(counts: np.ndarray, slot: int) -> Iterator[pa.RecordBatch]:
    """A task's counters as compressed blocks; blocks without a count are left out."""
    ids, blobs = [], []
    for b in range(0, len(counts), BLOCK):
        part = counts[b : b + BLOCK]
        if part.any():
            ids.append(b // BLOCK)
            blobs.append(zlib.compress(part.astype("<u4").tobytes(), 1))
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([slot] * len(ids), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "slot", "counts"])


BLOCK_SCHEMA = "block int, slot int, counts binary"


def sum_blocks(spark: SparkSession, blocks: DataFrame, size: int, partitions: int) -> np.ndarray:
    """The sum of all tasks' counters: added in two steps over the square root of the tasks each; `size` counters reach the driver, whatever the input."""
    slots = max(1, math.isqrt(partitions))

    def add(pdf):
        total = np.zeros(BLOCK, dtype=np.uint64)
        for x in pdf["counts"]:
            part = np.frombuffer(zlib.decompress(x), dtype="<u4")
            total[: len(part)] += part
        total = np.minimum(total, 2**32 - 1)
        pdf = pdf.iloc[:1].copy()
        pdf["counts"] = [zlib.compress(total.astype("<u4").tobytes(), 1)]
        return pdf

    df = blocks.withColumn("slot", F.col("slot") % slots)
    df = df.groupBy("block", "slot").applyInPandas(add, BLOCK_SCHEMA).groupBy("block").applyInPandas(add, BLOCK_SCHEMA)
    out = np.zeros(size, dtype=np.uint64)
    for r in df.select("block", "counts").collect():
        part = np.frombuffer(zlib.decompress(r["counts"]), dtype="<u4")
        a = r["block"] * BLOCK
        out[a : a + BLOCK] = part[: len(out[a : a + BLOCK])]
    return out


#: log2 of the bits of a membership filter (8 MB, whatever the input); false positives only cost time.
MEMBERS = 26


def member_bits(keys: DataFrame) -> np.ndarray:
    """A bit for the leading bits of every key (one column of longs), packed; the size is fixed."""
    def mark(it):
        from pyspark import TaskContext

        bits = np.zeros(1 << (MEMBERS - 3), dtype=np.uint8)
        for b in it:
            at = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - MEMBERS)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
        yield from emit_blocks(bits.view("<u4"), TaskContext.get().partitionId())

    # blocks are added up, and a bit may be set once only: each block's keys go to one task
    c = keys.columns[0]
    keys = keys.distinct().repartition(F.shiftrightunsigned(c, 64 - MEMBERS + 19))
    packed = sum_blocks(keys.sparkSession, keys.mapInArrow(mark, BLOCK_SCHEMA), (1 << MEMBERS) // 32, 1)
    return packed.astype("<u4").view(np.uint8)


def is_member(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) >> np.uint64(64 - MEMBERS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def text_hash(text_col: str) -> Column:
    return F.xxhash64(empty_to_string(text_col))


def without(docs: DataFrame, id_col: str, text_col: str, gone: DataFrame, repeats: DataFrame) -> DataFrame:
    """docs without the rows of gone (doc_id, h: the text's hash), and one row of each of repeats (doc_id, h).

    Rows that are sure to stay do not move: only those whose key is in a filter of 2**26 bits are joined.
    """
    bit = "cast(shiftrightunsigned(__key, 38) & 63 AS int)"
    keys = gone.unionByName(repeats).select(F.xxhash64("doc_id", "h").alias("__key"))
    words = keys.groupBy(F.shiftrightunsigned("__key", 44).alias("__w")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("__bits"))
    marked = docs.withColumn("__key", F.xxhash64(F.col(id_col).cast("long"), text_hash(text_col))).withColumn("__w", F.shiftrightunsigned("__key", 44))
    # 2**20 words at most, whatever the input
    marked = marked.join(F.broadcast(words), "__w", "left").withColumn("__may", F.expr(f"coalesce(shiftright(__bits, {bit}) & 1, 0L) = 1"))
    marked = marked.drop("__w", "__bits")
    sure = marked.where(~F.col("__may")).drop("__key", "__may")
    rest = marked.where("__may").withColumn("__h", text_hash(text_col))
    rest = rest.join(gone, (rest["__h"] == gone["h"]) & rest[id_col].cast("long").eqNullSafe(gone["doc_id"]), "left_anti")
    if repeats.take(1):
        # equal in id and text: the row whose columns hash least
        every = [F.col(f"`{c}`") for c in docs.columns]
        rest = rest.groupBy("__h", F.col(id_col).cast("long").alias("__id")).agg(F.min_by(F.struct(*every), F.xxhash64(*every)).alias("__row")).select("__row.*")
    else:
        rest = rest.drop("__key", "__may", "__h")
    return sure.unionByName(rest)
