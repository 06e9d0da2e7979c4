"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
rows that stay with the columns of documents; the last returns their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrano.llm import exact_dedup, jaccard_join, mixing, sentencepiece_dropout, toxicity
from terrano.llm.common import forget, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted toxic.

    Null and empty texts stay; of repeated rows all stay or none.  Learned from the labels in sf_dir of rows still in docs.
    """
    return toxicity.clean(docs, toxicity.fitted(spark, docs, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space aside, the row with the smallest doc_id.

    Null and empty texts are equal to one another; of rows that tie in id as well one stays.
    """
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard 0.8 or more.

    The smallest id of a group stays, null ids last.  Null and empty texts are in no group.
    """
    return jaccard_join.one_of_each(docs, k=5, t=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, by words and source weights.

    A null source is a source; null and empty texts have no words; repeated rows are taken each by its own hash.
    """
    return mixing.resampled(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row; null and empty texts have none, and repeated rows are each segmented anew."""
    return sentencepiece_dropout.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", tokenize),
]
#: SQL cannot express the fitted toxicity model nor the segmentation; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each written and read again; what a stage read goes once it is done.

    Empty tables and extra columns of any name pass through all stages but the last.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            forget(spark, before)
        before = docs
    return docs
