"""Language scores, toxic segments and copies of labelled texts against plain versions; edge cases of both."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrano.llm import language_id, toxicity
from terrano.llm.letters import runs

from .test_brute_force import SCHEMA

TEXT = {"aa": "the of and that with running thing", "bb": "der die und nicht mit laufen ding", "cc": "le la et que dans courant chose"}


def labelled(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(TEXT[g].split(), k=12)), g, None, 1, 1, 1, 1, "t", 1) for i in range(60) for g in [list(TEXT)[i % 3]]]
    rows += [(100, "only", "rare", None, 1, 1, 1, 1, "t", 1), (101, None, "aa", None, 1, 1, 1, 1, "t", 1), (102, "the", None, None, 1, 1, 1, 1, "t", 1), rows[0]]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_backoff_against_a_plain_version(spark):
    rows, df = labelled(spark)
    model = language_id.fit(df, "lang", "text", F.lit(True), F.xxhash64("doc_id"))
    assert model.langs == ["aa", "bb", "cc", "rare"]  # every language stays, however rare
    counts = {n: defaultdict(Counter) for n in (0, *language_id.ORDERS)}
    for r in rows:
        if r[2] and r[1]:
            for w in r[1].split():
                counts[0][r[2]][w] += 1
                for n in language_id.ORDERS:
                    for i in range(len(w) + 3 - n):
                        counts[n][r[2]][f"^{w}^"[i : i + n]] += 1

    def log(n, x, lang):
        every = len({y for c in counts[n].values() for y in c})
        total = sum(counts[n][lang].values())
        return math.log((counts[n][lang][x] + 0.5) / (total + 0.5 * every + 1))

    def score(w, lang):
        if any(c[w] for c in counts[0].values()):
            return log(0, w, lang)
        for n in language_id.ORDERS:
            known = [x for i in range(len(w) + 3 - n) for x in [f"^{w}^"[i : i + n]] if any(c[x] for c in counts[n].values())]
            if known:
                return sum(log(n, x, lang) for x in known) / len(known)
        return 0.0

    texts = ["the unddie thewith zzz", "qq", "laufende dinge running", "thething " * 50, "x", "le the der only", "9 - 9", ""]
    for _, x in runs(pa.array(texts)):
        out, n = model.scores(x)
    for t, got, k in zip(texts, out, n, strict=True):
        ws = [w for w in t.split() if w.isalpha()]
        assert k == len(ws)
        assert got.tolist() == pytest.approx([sum(score(w, lang) for w in ws) for lang in model.langs], abs=1e-6)


def test_language_of_odd_rows(spark):
    _, df = labelled(spark)
    model = language_id.fit(df, "lang", "text", F.lit(True), F.xxhash64("doc_id"))
    again = language_id.fit(df.repartition(7), "lang", "text", F.lit(True), F.xxhash64("doc_id"))
    assert all((model.tables[n].keys == again.tables[n].keys).all() and (model.tables[n].above == again.tables[n].above).all() for n in model.tables)
    odd = [(1, "the of " * 200_000, "bb"), (2, "der", "aa"), (2, "der", "aa"), (3, "", "x"), (None, "le la et", None), (4, "\u0000", "x")]
    got = [tuple(r) for r in language_id.identified(spark.createDataFrame(odd, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("s")), model).collect()]
    assert sorted((str(i), p) for i, p, _ in got) == sorted([("1", "aa"), ("2", "bb"), ("2", "bb"), ("3", "und"), ("None", "cc"), ("4", "und")])
    assert all(0 <= s <= 1 for _, _, s in got)


def test_segments_with_drift_and_skipped_words():
    """Places and scores of the maximal segments, by the definition: the best span, then both sides of it."""
    r = random.Random(9)
    for _ in range(300):
        drift, n = r.choice([0.25, 0.5, 1.0]), r.randint(1, 14)
        s = [r.choice([0, 0, 0, -0.5, 1, 2, 4]) for _ in range(n)]
        cost = [v if v else -drift for v in s]

        def split(a, b):
            best = None
            for i in range(a, b):
                for j in range(i + 1, b + 1):
                    x = (sum(cost[i:j]), -(j - i), -i)
                    if best is None or x > best[0]:
                        best = x, i, j
            return [] if best is None or best[0][0] <= 0 else [*split(a, best[1]), (best[1], best[2], best[0][0]), *split(best[2], b)]

        at = [i for i, v in enumerate(s) if v]
        import numpy as np

        got = toxicity.maximal_segments(np.array(at, dtype=int), np.array([s[i] for i in at], dtype=float), drift)
        assert [(a, b, round(x, 6)) for a, b, x in got] == [(a, b, round(x, 6)) for a, b, x in split(0, n)]


def test_copies_of_labelled_texts(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:59], "other"])
    rows = [(1, " ".join(base), 0, 1), (2, near, 1, 2), (3, " ".join(base), 0, 3), (4, "a b", 0, 0), (5, "a b", 1, 0), (6, None, 0, 0), (7, "", 1, 0),
            (8, " ".join(base[:10] + [f"z{i}" for i in range(90)]), 0, 0)]
    df = spark.createDataFrame(rows, "id long, text string, toxic int, part int")
    got = sorted(str(tuple(r)) for r in toxicity.without_copies(df).collect())
    again = sorted(str(tuple(r)) for r in toxicity.without_copies(df.repartition(5)).collect())
    assert got == again
    kept = {r.text: r.toxic for r in toxicity.without_copies(df).collect()}
    assert kept[" ".join(base)] == 1 and near not in kept  # what stays of the copies is toxic, as one of them is
    assert kept["a b"] == 1 and rows[7][1] in kept  # a text with a common passage is no copy


def test_toxicity_of_odd_rows(spark):
    rows = [(i, ("bad worse " if i % 4 == 0 else "fine good ") + " ".join(f"w{(i * j) % 97}" for j in range(40)), "a", "b", 1, 1, 1, 1, "t", 1) for i in range(200)]
    rows += [rows[0], rows[0], (None, "bad worse", None, None, 1, 1, 1, 1, "t", 1), (900, None, None, None, 1, 1, 1, 1, "t", 1), (901, "fine " * 300_000, None, None, 1, 1, 1, 1, "t", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), i) for i in range(200)] + [(0, 0, 1), (None, 1, 1), (5, None, 1)], "doc_id long, toxic int, text long")
    model = toxicity.fit(df, labels, "doc_id", "text", F.lit(True))
    got = toxicity.scored(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.predicted for r in got if r.doc_id == 0} == {1} and {r.predicted for r in got if r.doc_id in (900, 901)} == {0}
    none = toxicity.fit(df, labels.where("false"), "doc_id", "text", F.lit(True))
    assert {r.predicted for r in toxicity.scored(df, none).collect()} == {0}
