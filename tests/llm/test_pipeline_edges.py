"""The pipeline on nulls, empty and long texts, repeated rows, extra columns, and an empty table."""

from __future__ import annotations

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, cls long, h long, key long, toxic int"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(i % 9 == 0)) for i, r in enumerate(rows) if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_edges(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(r.randint(0, 60))), "en", r.choice(["s", "t", None]), 1, 2, 3, 4, 5, 6) for i in range(60)]
    rows += [(100, None, None, None, None, None, None, None, None, None), (101, "", None, "s", None, None, None, None, None, None), (None, "no id here", None, "s", None, None, None, None, None, None),
             (102, "long " * 40_000, "en", "s", 1, 1, 1, 1, 1, 1), rows[5], rows[5], (5, "another text of a repeated id", "en", "t", 1, 1, 1, 1, 1, 1)]
    write(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(x) for x in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = [tuple(x) for x in docs.collect()]
        assert docs.columns == names and set(after) <= set(before)
        if name in ("exact_dedup", "jaccard_join"):
            assert len(after) == len(set(after))
    tokens = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(tokens) == docs.count() and all(t.lossless for t in tokens)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, tokens)) == sorted(map(str, again))


def test_empty(spark, tmp_path):
    write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
