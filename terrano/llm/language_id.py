"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language.  An unseen word falls back to
the longest character n-grams (5 down to 1, with a mark at either end of the word) of which the
model knows any, scored by their mean log frequency.  A text's language has the largest sum.

The model is fitted on a bounded, seeded sample of labelled rows (TRAIN_DOCS for each language,
TRAIN_TOTAL in all); every language and every word and n-gram of the sample counts.  Its tables hold
what a language has seen; for all others of a table one log frequency a language is enough.
Prediction is one scan without a shuffle over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_to_string, kept_out, prepare
from .letters import lookup, runs

#: Documents of each language, and of all languages together, that the model is fitted on (in expectation).
TRAIN_DOCS = 1500
TRAIN_TOTAL = 20_000
ORDERS = (5, 4, 3, 2, 1)


@dataclass
class Table:
    """Log frequencies of the entries of one order: base by language, and above it where a language has seen an entry."""

    keys: np.ndarray
    off: np.ndarray
    lang: np.ndarray
    above: np.ndarray
    base: np.ndarray

    def add(self, out: np.ndarray, at: np.ndarray, text: np.ndarray, weight: np.ndarray) -> None:
        """Adds the log frequencies of the entries `at`, times weight, to the sums of their texts."""
        n = len(self.base)
        out += np.bincount(text, weight, len(out))[:, None] * self.base
        size = self.off[at + 1] - self.off[at]
        place = np.repeat(self.off[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        cell = np.repeat(text, size) * n + self.lang[place]
        out += np.bincount(cell, self.above[place] * np.repeat(weight, size), out.size).reshape(out.shape)


@dataclass
class Model:
    langs: list[str]
    #: By n-gram order, 0 for words.
    tables: dict[int, Table] = field(default_factory=dict)

    def scores(self, letters) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log scores by text and language, words by text)."""
        n_words = np.diff(letters.first)
        text = np.repeat(np.arange(len(n_words)), n_words)
        out = np.zeros((len(n_words), len(self.langs)))
        at = lookup(self.tables[0].keys, letters.hashes())
        known = at >= 0
        self.tables[0].add(out, at[known], text[known], np.ones(int(known.sum())))
        left = np.flatnonzero(~known)
        for n in ORDERS:
            if not len(left):
                break
            own, h = letters.grams(left, n)
            at = lookup(self.tables[n].keys, h)
            own, at = own[at >= 0], at[at >= 0]
            hits = np.bincount(own, minlength=len(left))
            self.tables[n].add(out, at, text[left[own]], 1 / hits[own])
            left = left[hits == 0]
        return out, n_words


COUNTS = "lang int, n int, h long, c long"


def fit(docs: DataFrame, lang_col: str, text_col: str, labelled: Column, key: Column, train_docs: int = TRAIN_DOCS) -> Model:
    """The model from a sample of the rows that are labelled; key spreads the rows evenly and alike on every run.

    Rows without a language or text, or with an empty one, teach nothing; repeated rows count each.  Without
    a labelled row, as in an empty table, no language is learned.
    """
    spark = docs.sparkSession
    docs = docs.where(labelled & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(key, F.lit(1 << 24)).alias("key"))
    sizes = sorted((r["lang"], r["count"]) for r in docs.groupBy("lang").count().collect())  # a row for each language
    langs = [x for x, _ in sizes]
    if not langs:
        zero = np.zeros(0, np.int64)
        return Model([], {n: Table(zero.view(np.uint64), np.zeros(1, np.int64), zero, zero, zero) for n in (0, *ORDERS)})
    most = min(train_docs, TRAIN_TOTAL / len(langs))
    share = spark.createDataFrame([(x, min(1.0, most / c) * (1 << 24)) for x, c in sizes], "lang string, share double")
    sample = docs.join(F.broadcast(share), "lang").where("key < share")
    index = {x: j for j, x in enumerate(langs)}

    def count(it):
        for b in it:
            names = b.column(0).to_pylist()
            for row, x in runs(b.column(1)):
                lang = np.array([index[v] for v in names[row : row + len(x.off) - 1]])
                own = np.repeat(lang, np.diff(x.first))
                every = np.arange(len(x.starts))
                for n in (0, *ORDERS):
                    who, h = (every, x.hashes()) if n == 0 else x.grams(every, n)
                    for j in np.unique(lang):
                        u, c = np.unique(h[own[who] == j], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), j), pa.int32()), pa.array(np.full(len(u), n), pa.int32()), pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "n", "h", "c"])

    counts = sample.select("lang", "text").mapInArrow(count, COUNTS).groupBy("lang", "n", "h").agg(F.sum("c").alias("c"))
    found = counts.toArrow()  # bounded by the sample
    lang, order, h, c = (found.column(x).to_numpy() for x in ("lang", "n", "h", "c"))
    model = Model(langs)
    for n in (0, *ORDERS):
        pick = np.flatnonzero(order == n)
        pick = pick[np.lexsort((lang[pick], h[pick].view(np.uint64)))]
        keys, first = np.unique(h[pick].view(np.uint64), return_index=True)
        total = np.bincount(lang[pick], c[pick], len(langs))
        base = np.log(0.5 / (total + 0.5 * len(keys) + 1))
        model.tables[n] = Table(keys, np.append(first, len(pick)), lang[pick].astype(np.int64), np.log(2.0 * c[pick] + 1), base)
    return model


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, from the text alone.

    lang_pred is `und` and score 0 if the text is null, empty or without letters, or if no
    language was learned.  Ties go to the first language by name.  Repeated rows are alike.  Texts
    are read whole, however long.  Other columns are not read.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(it):
        m = sent.value
        for b in it:
            names, probs = [], []
            for _, x in runs(b.column(1)):
                if not m.langs:
                    names += ["und"] * (len(x.off) - 1)
                    probs += [0.0] * (len(x.off) - 1)
                    continue
                total, n = m.scores(x)
                soft = total / np.sqrt(np.maximum(n, 1))[:, None]
                soft = np.exp(soft - soft.max(1, keepdims=True))
                best = total.argmax(1)
                p = soft[np.arange(len(best)), best] / soft.sum(1)
                names += [m.langs[j] if k else "und" for j, k in zip(best, n, strict=True)]
                probs += np.where(n > 0, p, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(probs, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identified() over documents, learned from rows that are not held out; null and empty texts as stated there."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    labelled = F.col("doc_id").isNotNull() & ~kept_out(F.col("doc_id"), 3, 1)
    model = fit(docs, "lang", "text", labelled, F.xxhash64(F.lit("lang"), "doc_id", F.xxhash64(empty_to_string("text"))))
    return identified(docs, model).select("doc_id", kept_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
