"""License scans by exact set-similarity join, on DataFrame operations only.

Text blocks (sentences; a line's end does not end one, an empty line does) are joined with license
templates: a block meets a template if it holds at least THRESHOLD of the template's distinct words.
Words are ordered by their frequency over all documents, the rarest first; a block can only meet
a template if it holds one of the template's first |T| - ceil(THRESHOLD |T|) + 1 words (prefix
filter, an equi-join with the index of these words), has enough words (length filter), and the words
after the first common one can still make up the threshold (positional filter).  A pair is made at its
first common prefix word, so it is verified once.

A label needs more than the threshold, as templates of one family share most of their words: the words
that tell a template from its like must stand in the block, and a template whose words another one
met there holds as well gives way to it.

Texts are read twice, to count template words and to find the blocks that hold a prefix word; only these
blocks go on, in a written table.  The templates are a parameter of bounded size.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_to_string, stored

#: Base phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Templates of the method: label, words that must stand in the block, text of the notice.
TEMPLATES = [
    ("apache-2.0", "apache", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache compliance", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0-disclaimer", "basis conditions", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit-notice", "mit", "released under the mit license"),
    ("mit-text", "granted person copy", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-text", "granted sublicense", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-warranty", "noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "fee granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution binary", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistribution conditions", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "neither endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl-3.0", "gnu 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "gnu 2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0", "gnu general 3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "gnu general 2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "lesser", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3.0", "affero", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("bsl-1.0", "boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "waived neighboring", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-4.0", "cc by", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "cc nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "cc sa", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "creative attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "creative noncommercial", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa-4.0", "creative sharealike", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("all-rights-reserved", "rights reproduced", "all rights reserved no part of this publication may be reproduced"),
]
THRESHOLD = 0.8
#: Words of all templates together that may be broadcast.
MAX_WORDS = 1_000_000
#: Separators between words of lower-cased text.
SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same on text as it stands: A-Z are parts of words.
SEP_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_ANY = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Blocks end at an empty line, and at a stop followed by white space.
EMPTY_LINE = r"\n[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*"
BLOCK_END = EMPTY_LINE + r"|[.!?;](?=[\x20\x09-\x0D]|\z)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def distinct_words(template: str) -> list[str]:
    return list(dict.fromkeys(template.split()))


def need(template: str) -> int:
    return math.ceil(THRESHOLD * len(distinct_words(template)) - 1e-9)


def wider(templates: list[tuple[str, str, str]]) -> list[list[int]]:
    """For each template the others that hold all its words and more."""
    sets = [set(t.split()) for _, _, t in templates]
    return [[j for j, b in enumerate(sets) if a < b] for a in sets]


def place(phrase: str) -> str:
    """A regular expression for a place where the phrase's words stand consecutively, in either case."""
    return f"(?i)(?<!{WORD_ANY})" + SEP_ANY.join(phrase.split()) + f"(?!{WORD_ANY})"


def word_frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """How often each template word occurs over all documents; one row for each word reaches the driver."""
    words = F.split(F.lower(empty_to_string(text_col)), SEP)  # only an order comes from it
    rows = docs.select(F.explode(F.filter(words, lambda w: w.isin(vocabulary))).alias("w")).groupBy("w").count().collect()
    return {w: 0 for w in vocabulary} | {r["w"]: r["count"] for r in rows}


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def met(blocks: DataFrame, templates: list[tuple[str, str, str]], order) -> DataFrame:
    """(rid, bno, block, label, share) of every block (rid, bno, block, w, n) that meets a template and is labelled by it.

    w are the block's template words in the global order, n its distinct words.
    """
    spark, rows, index = blocks.sparkSession, [], []
    for tid, ((label, keys, text), over) in enumerate(zip(templates, wider(templates), strict=True)):
        ws, k = order(distinct_words(text)), need(text)
        rows.append((tid, label, ws, k, keys.split(), over))
        index += [(w, i, tid) for i, w in enumerate(ws[: len(ws) - k + 1])]
    table = spark.createDataFrame(rows, "tid int, label string, q array<string>, k int, keys array<string>, over array<int>")
    index = spark.createDataFrame(index, "word string, i int, tid int").join(F.broadcast(table), "tid")
    pairs = blocks.select("rid", "bno", "block", "w", "n", F.posexplode("w").alias("j", "word")).join(F.broadcast(index), "word")
    # the first common word of the prefix; those before it are not common, the rest of both is behind it
    first = F.size(F.array_intersect(F.slice("q", F.lit(1), F.col("i")), "w")) == 0
    bound = 1 + F.least(F.size("q") - 1 - F.col("i"), F.size("w") - 1 - F.col("j"))
    common = F.size(F.array_intersect("q", "w"))
    pairs = pairs.where((F.col("n") >= F.col("k")) & first & (bound >= F.col("k")) & (common >= F.col("k")) & (F.size(F.array_except("keys", "w")) == 0))
    every = pairs.groupBy("rid").agg(F.collect_list(F.struct("bno", "block", "label", (common / F.size("q")).alias("share"), "tid", "over")).alias("m"))
    left = F.filter("m", lambda x: ~F.exists(F.col("m"), lambda y: (y["bno"] == x["bno"]) & F.array_contains(x["over"], y["tid"])))
    return every.select("rid", F.transform(left, lambda x: F.struct(x["block"].alias("block"), x["label"].alias("label"), x["share"].alias("share"))).alias("matches"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    matches lists (block, label, share) of every block that meets a template.  score is 1 with a
    base place, else the largest share of a template that a block holds, 0 without one.  Null text
    is empty: no words, no labels.  Repeated rows are scanned each on its own, texts whole, however long.
    Other columns are not read, whatever their names.  An empty table gives an empty result.
    """
    vocabulary = sorted({w for _, _, t in templates for w in t.split()})
    if sum(len(t.split()) for _, _, t in templates) > MAX_WORDS:
        raise ValueError(f"templates of more than {MAX_WORDS} words")
    count = word_frequencies(docs, text_col, vocabulary)
    order = lambda ws: sorted(ws, key=lambda w: (count[w], w))
    rare = sorted({w for _, _, t in templates for w in order(distinct_words(t))[: len(distinct_words(t)) - need(t) + 1]})
    t = F.col("t")
    base_places = [place(p) for p, _ in PHRASES]
    hint = "(?i)" + "|".join(sorted({p.split()[0] + SEP_ANY + p.split()[1] for p, _ in PHRASES}))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), empty_to_string(text_col).alias("t"))
    # lower() may turn other letters into A-Z as well: the number of words is the same, and the hint only lets more through
    rows = rows.select("rid", "doc_id", "t", F.split(F.lower("t"), SEP).alias("all"), t.rlike(hint).alias("hint"))
    edges = F.when(F.get("all", F.lit(0)) == "", 1).otherwise(0) + F.when((F.size("all") > 1) & (F.element_at("all", -1) == ""), 1).otherwise(0)
    rows = rows.select("rid", "doc_id", "t", "hint", (F.size("all") - edges).cast("long").alias("n_words"), F.arrays_overlap("all", _words(rare)).alias("near"))

    def words_before(c: Column) -> Column:
        return F.size(F.filter(F.split(c, SEP_ANY), lambda x: x != ""))

    # Phrases may share a word at their ends, so each is searched on its own.
    hits = [F.when(F.col("hint"), F.regexp_count(t, F.lit(p))).otherwise(0) for p in base_places]
    first = [F.when(h > 0, words_before(F.regexp_extract(t, f"(?s)^(.*?){p}", 1))) for p, h in zip(base_places, hits, strict=True)]
    last = [F.when(h > 0, words_before(F.regexp_extract(t, f"(?s)^(.*){p}", 1))) for p, h in zip(base_places, hits, strict=True)]
    # blocks with their distinct words, only where there is a prefix word
    blocks = F.transform(F.split(t, BLOCK_END), lambda b: F.struct(b.alias("block"), F.array_distinct(F.filter(F.split(F.translate(b, UPPER, LOWER), SEP), lambda x: x != "")).alias("w")))
    blocks = F.when(F.col("near"), F.filter(blocks, lambda b: F.arrays_overlap(b["w"], _words(rare))))
    blocks = F.transform(blocks, lambda b: F.struct(b["block"].alias("block"), F.array_intersect(_words(order(vocabulary)), b["w"]).alias("w"), F.size(b["w"]).alias("n")))
    rows = rows.select("rid", "doc_id", "n_words", *[h.alias(f"hits{i}") for i, h in enumerate(hits)], *[x.alias(f"first{i}") for i, x in enumerate(first)], *[x.alias(f"last{i}") for i, x in enumerate(last)], blocks.alias("blocks"))
    n_base = reduce(lambda a, b: a + b, [F.col(f"hits{i}") for i in range(len(PHRASES))]).cast("long")
    base = F.array_sort(F.filter(F.array(*[F.when(F.col(f"hits{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull()))
    rows = stored(rows.select(
        "rid", "doc_id", "n_words", n_base.alias("n_base"), base.alias("base"), "blocks",
        F.least(*[F.col(f"first{i}") for i in range(len(PHRASES))]).cast("long").alias("first_word"),
        F.greatest(*[F.col(f"last{i}") for i in range(len(PHRASES))]).cast("long").alias("last_word")))
    inside = rows.where(F.size("blocks") > 0).select("rid", F.posexplode("blocks").alias("bno", "b")).select("rid", "bno", "b.block", "b.w", "b.n")
    rows = rows.drop("blocks").join(met(inside, templates, order), "rid", "left")
    rows = rows.withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<block:string,label:string,share:double>>")))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("matches", lambda m: m["label"]))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))).alias("score"),
        "matches",
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scanned() over documents; null, empty and repeated rows as stated there."""
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("matches")


def _sql() -> str:
    phrases = ", ".join(f"({[*p.split()]!r}, '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"({i}, {distinct_words(t)!r}, '{label}', {need(t)}, {keys.split()!r}, {over or [-1]!r})" for i, ((label, keys, t), over) in enumerate(zip(TEMPLATES, wider(TEMPLATES), strict=True)))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w, t FROM d),
p(p, label) AS (VALUES {phrases}),
q(tid, q, label, k, keys, over) AS (VALUES {templates}),
hit AS (
  SELECT r, label, i - 1 AS pos FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w), p
  WHERE list_slice(w, i, i + len(p) - 1) = p),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM hit GROUP BY r),
para AS (SELECT r, replace(unnest(regexp_split_to_array(t, '{EMPTY_LINE}')), chr(10), ' ') AS x FROM w),
block AS (
  SELECT row_number() OVER () AS bno, r, list_distinct(regexp_split_to_array(b, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS b
  FROM (SELECT r, unnest(regexp_split_to_array(regexp_replace(x, '[.!?;]([\x20\x09-\x0D]|$)', chr(10) || '\1', 'g'), '\n')) AS b FROM para)),
every AS (
  SELECT r, bno, tid, label, over, len(list_intersect(q, b)) / len(q) AS share FROM block, q WHERE len(list_intersect(q, b)) >= k AND list_has_all(b, keys)),
met AS (
  SELECT r, label, share FROM every x
  WHERE NOT EXISTS (SELECT 1 FROM every y WHERE y.bno = x.bno AND list_contains(x.over, y.tid))),
method AS (SELECT r, list(DISTINCT label) AS method, max(share) AS share FROM met GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(method, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN method USING (r)
"""


SQL = _sql()
