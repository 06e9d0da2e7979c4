"""Toxicity by maximum-scoring segments of token log-odds.

Tokens (lower-cased letter words; a word that says nothing by itself stands for its first
four letters) get the log-odds of toxic against clean documents under Dirichlet priors; only
significant ones count, every other token costs a small drift that keeps the expectation in
clean text negative.  One linear scan over a text finds all maximal-scoring segments.  Scores of
segments follow an extreme-value law in clean text: lambda solves the score equation of the
clean token distribution and K is fitted to clean documents, so a segment of score S in N tokens
is expected K N exp(-lambda S) times by chance.  The evidence of all segments expected less than
once is added up, and a logistic curve, centred on a part of the sample that the tokens were not
learned from, maps it to 0..1.

Labels are sampled (MAX_TOXIC and MAX_CLEAN documents in expectation, a bounded broadcast);
scoring is one scan without a shuffle over all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, kept_out, prepare, stored
from .letters import lookup, runs

#: Labelled documents that the model is fitted on (in expectation).
MAX_TOXIC = 3000
MAX_CLEAN = 9000
#: Pseudo-counts: spread by overall frequency, and for each token.
PRIOR, FLOOR = 100.0, 0.5
#: z-score from which a token's log-odds count.
SIGNIFICANT = 2.6
HEAD = 4
#: Jaccard similarity of three-word runs from which labelled texts count as copies.
COPY = 0.8


@dataclass
class Model:
    keys: np.ndarray
    odds: np.ndarray
    heads: np.ndarray
    head_odds: np.ndarray
    drift: float = 0.0
    lam: float = 1.0
    k: float = 0.1
    centre: float = 2.0

    def tokens(self, x) -> np.ndarray:
        """The log-odds of each word, 0 for those that say nothing."""
        at = lookup(self.keys, x.hashes())
        out = np.where(at >= 0, self.odds[at] if len(self.odds) else 0.0, 0.0)
        if len(self.heads):
            long_, h = x.heads(HEAD)
            hit = lookup(self.heads, h)
            use = (hit >= 0) & (out[long_] == 0)
            out[long_[use]] = self.head_odds[hit[use]]
        return out

    def segments(self, at: np.ndarray, odds: np.ndarray) -> list[tuple[int, int, float]]:
        return maximal_segments(at, odds, self.drift)

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        base = math.log(max(self.k * max(n, 1), 1e-300))
        return sum(max(0.0, self.lam * s - base) for _, _, s in found)

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(min(700.0, self.centre - evidence)))


def maximal_segments(at: np.ndarray, odds: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, end word, score), in linear time.

    at, odds: places and log-odds of the words that count; every word between costs `drift`.
    Each stack entry is a candidate with the cumulative score left and right of it; a new one is
    joined with the latest entry whose left side lies lower and whose right side lies no higher.
    """
    stack: list[list] = []  # first, end, left sum, right sum, entry with a lower left sum
    total, last = 0.0, -1
    for i, v in zip(at.tolist(), odds.tolist(), strict=True):
        total -= drift * (i - last - 1)
        last = i
        left, total = total, total + v
        if v <= 0:
            continue
        entry = [i, i + 1, left, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= entry[2]:
                j = stack[j][4]
            entry[4] = j
            if j < 0 or stack[j][3] >= entry[3]:
                stack.append(entry)
                break
            entry = [stack[j][0], entry[1], stack[j][2], entry[3], stack[j][4]]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


COUNTS = "toxic int, head boolean, h long, c long"


def token_counts(sample: DataFrame) -> DataFrame:
    """Documents of either class that hold a token, from a table (text, toxic)."""
    def count(it):
        for b in it:
            toxic = b.column(1).to_numpy()
            for row, x in runs(b.column(0)):
                label = np.repeat(toxic[row : row + len(x.off) - 1], np.diff(x.first))
                doc = np.repeat(np.arange(len(x.off) - 1), np.diff(x.first)).astype(np.uint64)
                long_, heads = x.heads(HEAD)
                for head, h, d, who in ((False, x.hashes(), doc, label), (True, heads, doc[long_], label[long_])):
                    for t in (0, 1):
                        pick = who == t
                        pairs = np.unique(np.stack([h[pick], d[pick]]), axis=1)[0] if pick.any() else np.zeros(0, np.uint64)
                        u, c = np.unique(pairs, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), t), pa.int32()), pa.array([head] * len(u), pa.bool_()), pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["toxic", "head", "h", "c"])

    return sample.select("text", F.col("toxic").cast("int")).mapInArrow(count, COUNTS)


def log_odds(counts: DataFrame) -> Model:
    """Dirichlet log-odds of the tokens whose z-score is significant."""
    c = counts.groupBy("head", "h").agg(F.sum(F.when(F.col("toxic") == 1, F.col("c")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("c")).otherwise(0)).alias("n"))
    whole = {r["head"]: (float(r["t"]), float(r["n"])) for r in c.groupBy("head").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()}
    tables = []
    for head in (False, True):
        nt, nc = whole.get(head, (0.0, 0.0))
        prior = F.lit(PRIOR / max(nt + nc, 1.0)) * (F.col("t") + F.col("n")) + FLOOR
        odds = F.log((F.col("t") + prior) / (nt + PRIOR - F.col("t") + 1)) - F.log((F.col("n") + prior) / (nc + PRIOR - F.col("n") + 1))
        z = odds / F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("n") + prior))
        rows = c.where(F.col("head") == head).withColumn("odds", odds).withColumn("z", z).where(F.abs("z") >= SIGNIFICANT)
        if head:  # many words share their first letters: only those that point to toxic text stand for them
            rows = rows.where("z > 0 AND t > 20 * n")
        p = rows.select("h", "odds").toPandas()  # bounded by the sample
        keys = p["h"].to_numpy(dtype=np.int64).view(np.uint64)
        o = np.argsort(keys)
        # a word of clean text must not outweigh the toxic ones around it
        tables += [keys[o], np.maximum(p["odds"].to_numpy(dtype=float)[o], -0.5)]
    return Model(*tables)


def calibrated(model: Model, sample: DataFrame) -> Model:
    """drift, lambda, K and centre from a table (text, toxic) of bounded size."""
    send = sample.sparkSession.sparkContext.broadcast

    def collect(m: Model, fn, schema: str):
        sent = send(m)

        def each(it):
            for b in it:
                toxic = b.column(1).to_numpy()
                for row, x in runs(b.column(0)):
                    odds = sent.value.tokens(x)
                    for i in range(len(x.off) - 1):
                        own = odds[x.first[i] : x.first[i + 1]]
                        yield from fn(sent.value, int(toxic[row + i]), own)

        def batches(it):
            rows = list(each(it))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.float64()))], names=["toxic", "n", "x"])

        return sample.select("text", F.col("toxic").cast("int")).mapInArrow(batches, schema)

    schema = "toxic int, n long, x double"
    # the clean token distribution, positive log-odds rounded to tenths
    def clean(m, t, own):
        if t == 0:
            u, c = np.unique(np.round(own, 1), return_counts=True)
            yield from ((0, int(k), float(v)) for v, k in zip(u, c, strict=True))

    hist = collect(model, clean, schema).groupBy("x").agg(F.sum("n").alias("n")).toPandas()
    x, n = hist["x"].to_numpy(float), hist["n"].to_numpy(float)
    total = max(n.sum(), 1.0)
    gain = float((x[x > 0] * n[x > 0]).sum() / total)
    model.drift = 0.005 + 2 * gain
    x = np.where(x == 0, -model.drift, x)
    low, high = 1e-6, 20.0
    if (x > 0).any():
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if float((n / total * np.exp(np.minimum(mid * x, 700))).sum()) < 1 else (low, mid)
        model.lam = min(max(high, 0.2), 2.0)

    def best(m, t, own):
        at = np.flatnonzero(own)
        found = m.segments(at, own[at])
        yield t, len(own), max((s for _, _, s in found), default=0.0)

    top = collect(model, best, schema).toPandas()
    clean_top = top[top["toxic"] == 0]
    hits = clean_top["x"][clean_top["x"] > 0]
    if len(hits) >= 5:
        s0 = float(hits.median())
        model.k = max(1e-6, float((clean_top["x"] >= s0).sum() / max((clean_top["n"] * math.exp(-model.lam * s0)).sum(), 1e-9)))

    def weigh(m, t, own):
        at = np.flatnonzero(own)
        yield t, len(own), m.evidence(m.segments(at, own[at]), len(own))

    w = collect(model, weigh, schema).toPandas()
    x, t = w["x"].to_numpy(float), w["toxic"].to_numpy(int)
    if t.sum():
        cuts = np.unique(x)
        cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else np.array([1.0])
        if len(cuts) > 500:
            cuts = np.quantile(cuts, np.linspace(0, 1, 500))
        f1 = [2 * (t[x > c] == 1).sum() / max((x > c).sum() + t.sum(), 1) for c in cuts]
        good = cuts[np.array(f1) >= max(f1) - 1e-12]
        model.centre = float(max(0.5, np.median(good)))
    return model


def without_copies(sample: DataFrame) -> DataFrame:
    """(text, toxic, part) of a bounded sample (id, text, toxic, part), of copies the one of the least id; a written table.

    Copies would make every word of one toxic text look toxic.  Texts that share their least three-word
    run are compared with the first of them by id; from COPY on they are copies, and if any of them is
    toxic, what stays is.  Shorter texts are copies if they are equal.
    """
    def runs_of(text: str) -> Column:
        w = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: F.xxhash64(x))
        both = lambda x, y: F.xxhash64(x, y)
        runs = F.zip_with(F.zip_with(w, F.slice(w, 2, 1 << 30), both), F.slice(w, 3, 1 << 30), both)
        return F.slice(runs, F.lit(1), F.greatest(F.size(w) - 2, F.lit(1)))

    # equal texts first: they reach the one that stays as one row a task
    text = F.coalesce("text", F.lit(""))
    sample = sample.groupBy(text.alias("text")).agg(F.min("id").alias("id"), F.max("toxic").alias("toxic"), F.min_by("part", "id").alias("part"))
    sample = stored(sample.withColumn("gram", F.array_min(runs_of("text"))))
    heads = sample.groupBy("gram").agg(F.min(F.struct("id", F.xxhash64("text").alias("h"))).alias("head"), F.count("*").alias("c")).where("c > 1").select("gram", "head")
    several = sample.join(heads, "gram").withColumn("first", F.struct("id", F.xxhash64("text").alias("h")) == F.col("head")).withColumn("set", F.array_distinct(runs_of("text")))
    head = several.where("first").select("gram", F.col("set").alias("hset"))
    both = F.size(F.array_intersect("set", "hset"))
    like = both >= COPY * (F.size("set") + F.size("hset") - both)
    rows = several.join(head, "gram").select("gram", "text", "toxic", "part", "first", like.alias("copy"))
    toxic = rows.where("copy").groupBy("gram").agg(F.max("toxic").alias("worst"))
    alone = sample.join(heads, "gram", "left_anti").select("text", "toxic", "part")
    out = stored(alone.unionByName(rows.where("NOT copy").select("text", "toxic", "part")).unionByName(rows.where("first").join(toxic, "gram").select("text", F.col("worst").alias("toxic"), "part")))
    forget(sample.sparkSession, sample)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, usable: Column) -> Model:
    """The model from labels (id, toxic); usable: which ids may be learned from.  Conflicting labels of an id count as toxic.

    Null ids and labels, null and empty texts teach nothing; without a labelled row no token is learned
    and every text gets the lowest score.  Equal inputs give the same model on every run.
    """
    labels = labels.where(usable & F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, MAX_TOXIC / max(sizes.get(1, 0), 1)))).otherwise(F.lit(min(1.0, MAX_CLEAN / max(sizes.get(0, 0), 1))))
    key = F.pmod(F.xxhash64(F.lit("toxic"), "__id"), F.lit(1 << 24))
    labels = labels.where(key < share * (1 << 24)).withColumn("part", F.pmod(F.shiftright(F.xxhash64(F.lit("toxic"), "__id"), 30), F.lit(4)))
    # at most MAX_TOXIC + MAX_CLEAN rows in expectation
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(labels), "__id").select(F.col("__id").alias("id"), "text", "toxic", "part")
    sample = without_copies(sample)
    part = calibrated(log_odds(token_counts(sample.where("part > 0"))), sample.where("part = 0"))
    whole = log_odds(token_counts(sample))
    whole.drift, whole.lam, whole.k, whole.centre = part.drift, part.lam, part.k, part.centre
    forget(docs.sparkSession, sample)
    return whole


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted, passages (first word, end word, score of each significant segment).

    Null and empty texts have no passage and the lowest score.  Repeated rows are alike.  Texts are
    read whole, however long; other columns are not read.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    passages = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def score(it):
        m = sent.value
        for b in it:
            out, found = [], []
            for _, x in runs(b.column(1)):
                odds = m.tokens(x)
                hit = np.flatnonzero(odds)
                bound = np.searchsorted(hit, x.first)
                for i in range(len(x.off) - 1):
                    a, z = bound[i], bound[i + 1]
                    n = int(x.first[i + 1] - x.first[i])
                    segs = m.segments(hit[a:z] - x.first[i], odds[hit[a:z]]) if z > a else []
                    out.append(m.score(m.evidence(segs, n)))
                    base = math.log(max(m.k * max(n, 1), 1e-300))
                    found.append([{"first": p, "end": q, "score": s} for p, q, s in segs if m.lam * s > base])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32()), pa.array(found, passages)], names=["doc_id", "score", "predicted", "passages"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(score, "doc_id long, score double, predicted int, passages array<struct<first:int,end:int,score:double>>")


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input rows that are not predicted toxic, all columns as they came; one scan, no shuffle.

    Null and empty texts stay; of repeated rows all stay or none.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(it):
        m = sent.value
        for b in it:
            ok = []
            for _, x in runs(b.column(at)):
                odds = m.tokens(x)
                hit = np.flatnonzero(odds)
                bound = np.searchsorted(hit, x.first)
                for i in range(len(x.off) - 1):
                    p = hit[bound[i] : bound[i + 1]]
                    n = int(x.first[i + 1] - x.first[i])
                    ok.append(m.score(m.evidence(m.segments(p - x.first[i], odds[p]) if len(p) else [], n)) < 0.5)
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(docs, labels, "doc_id", "text", ~kept_out(F.col("doc_id"), 5, 0))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored() over documents, learned from labels that are not held out; null and empty texts as stated there."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    out = scored(docs, fitted(spark, docs, sf_dir))
    return out.select("doc_id", kept_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
