"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive bytes of their normalised text, the leading ones first.  A
level looks at the next `width` bytes of every document that is still in company; documents
with the same node and the same bytes go on together, a document alone in its node is settled,
and so is a node whose texts end within the level.  Widths grow eightfold, so a text of n bytes
takes O(log n) levels and only texts that still have company are read again.  Nothing is
compared by digest; the SHA-256 is only reported.

Hot groups: a node is counted with partial aggregation, so a million copies reach a reducer as
one row for each map task, and documents meet their node in an equi-join that adaptive
execution splits on the document side.  Nodes are rows of a table and never reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_to_string, forget, prepare, stored, text_hash, without

FIRST_WIDTH = 64
GROWTH = 8
#: Runs to replace: one that starts with another character than the space, or that is longer than one.
RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str):
    return F.regexp_replace(empty_to_string(text), RUN, " ")


def _settled(docs: DataFrame, id_col: str, text_col: str, carried: dict[str, Column]) -> tuple[DataFrame, list[DataFrame]]:
    """(rows with doc_id, the carried columns, group_size, keep_id and their node's number and level; the tables they come from)."""
    work = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).cast("binary").alias("t"), *[c.alias(x) for x, c in carried.items()])
    work = work.withColumn("node", F.lit(0).cast("long"))
    kept = ["doc_id", *carried]
    at, width, done, tables = 1, FIRST_WIDTH, [], []
    while True:
        level = work.withColumn("piece", F.substring("t", at, width))
        nodes = (level.groupBy("node", "piece").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
                 .where("n > 1").withColumn("next", F.monotonically_increasing_id()))
        nodes = stored(nodes)
        alone = F.col("n").isNull()
        ended = F.length("piece") < width
        # a merge join at every size: it splits hot nodes on the document side, and nodes are never broadcast
        met = level.join(nodes.hint("merge"), ["node", "piece"], "left").select(
            *kept,
            F.coalesce("n", F.lit(1)).alias("group_size"),
            F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("keep_id"),
            F.coalesce("next", F.lit(-1)).alias("node"),
            (alone | ended).alias("settled"),
            F.when(~(alone | ended), F.col("t")).alias("t"),
        )
        met = stored(met)
        tables.append(met)
        done.append(met.where("settled").select(*kept, "group_size", "keep_id", "node", F.lit(at).alias("level")))
        forget(docs.sparkSession, nodes)
        work = met.where("NOT settled").select(*kept, "t", "node")
        if not work.take(1):
            break
        at, width = at + width, width * GROWTH
    return reduce(DataFrame.unionByName, done), tables


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty.  keep_id is the smallest non-null id of the equal texts (null if
    none has an id).  If several equal rows carry keep_id, exactly one of them is kept.  An empty
    table gives an empty result; other columns may have any name.
    """
    out, _ = _settled(docs, id_col, text_col, {"sha": F.sha2(normalised(text_col).cast("binary"), 256)})
    # Of rows that share a text and the smallest id one stays; only such rows are ranked, one or few per group.
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    tag = F.monotonically_increasing_id()
    single = out.where((F.col("group_size") == 1) | ~first).withColumn("kept", F.col("group_size") == 1)
    ranked = out.where((F.col("group_size") > 1) & first).withColumn("tag", tag)
    best = ranked.groupBy("level", "node").agg(F.min("tag").alias("best"))
    ranked = ranked.join(best, ["level", "node"]).withColumn("kept", F.col("tag") == F.col("best")).drop("tag", "best")
    out = single.unionByName(ranked)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, all columns as they came: of equal texts the row of keep_id, and of several
    such rows the one whose text as it stands, then whose columns hash least."""
    spark = docs.sparkSession
    prepare(spark)
    out, tables = _settled(docs, id_col, text_col, {"h": text_hash(text_col)})
    out = out.withColumn("doc_id", F.col("doc_id").cast("long")).where("group_size > 1")
    first = out.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    least = first.groupBy("level", "node").agg(F.min("h").alias("least"))
    gone = out.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "h").unionByName(first.join(least, ["level", "node"]).where("h != least").select("doc_id", "h"))
    gone = stored(gone.distinct())
    repeats = stored(first.groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h"))
    forget(spark, *tables)
    return without(docs, id_col, text_col, gone, repeats)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_groups() over documents; null, empty and repeated rows as stated there."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""
