"""Every operator against a plain version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from terrano.llm import exact_dedup, html_extraction, jaccard_join, language_id, license_scan, mixing, quality_rules, sentencepiece_dropout, substring_dedup, toxicity

WS = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, cls long, h long, t string, node long"


def words(x):
    return [w for w in WS.split(x or "") if w]


def corpus():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdeéfghl") for _ in range(r.randint(1, 7))) for _ in range(400)]
    base = [" ".join(r.choice(vocab) for _ in range(n)) for n in (3, 12, 30, 60, 200, 900)]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    texts = [None, "", "   ", "a", "a b", "A  b", "a b\n", "x" * 3000, base[0], base[0]]
    for b in base[1:]:
        for _ in range(4):
            w = b.split()
            w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w))
        texts += [b, b.replace(" ", "\t\n"), b.upper(), b + " " + passage, passage + " " + b + "\n" + passage]
    texts += [" ".join(r.choice(vocab) for _ in range(20_000)), ("dup line\n" * 30) + "end"]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["s0", "s0", "s1", "é", None]), 1, 2, 3, 4, "x", 5) for i, t in enumerate(texts)]
    rows += [rows[-3], (None, base[2], None, None, None, None, None, None, None, None), (7, "other text of a repeated id", "en", "s1", 1, 1, 1, 1, "t", 1)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((v is None, str(v)) for v in r)


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for r in corpus():
        groups[WS.sub(" ", r[1] or "")].append(r[0])
    want = [(i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.deduplicated(docs).count() == len(groups) and exact_dedup.deduplicated(docs).columns == docs.columns
    assert exact_dedup.exact_groups(empty).count() == 0


@pytest.mark.parametrize("k,t", [(3, 90), (5, 80)])
def test_jaccard_join(docs, empty, k, t):
    sets = []
    for r in corpus():
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(r[1])]
        sets.append((r[0], {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= t * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        least[find(i)].append(d)
    want = [(d, len(s), min((x for x in least[find(i)] if x is not None), default=None) if s else d) for i, (d, s) in enumerate(sets)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.linked(docs, k=k, t=t).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    if k == 3:
        assert jaccard_join.linked(empty).count() == 0


def test_substring_dedup(docs, empty):
    rows = corpus()
    big = 1 << 62
    least = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            least[g] = min(least.get(g, big), big if r[0] is None else r[0])
    want = []
    for r in rows:
        w, gone = words(r[1]), set()
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < (big if r[0] is None else r[0]):
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substring_dedup.deduplicated(docs, texts=False).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert substring_dedup.deduplicated(empty).count() == 0


def test_quality_rules(docs, empty):
    want = []
    for r in corpus():
        t, w = r[1] or "", words(r[1])
        seen = defaultdict(list)
        for i in range(len(w) - 4):
            seen[tuple(w[i : i + 5])].append(i)
        cover = {i + j for v in seen.values() if len(v) > 1 for i in v for j in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    got = quality_rules.quality(docs).collect()
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.quality(empty).count() == 0


def test_license_scan(spark, empty):
    texts = [None, "", "MIT License mit  license", "The GNU General Public License", "licensed under the Apache License, Version 2.0.", "cc by-nc", "xcc by", "cc bye",
             "long " * 500 + "Released under the MIT license.\nApache LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy", "mit mit license cc by cc by",
             "Redistribution and use in source and binary forms, with or without\nmodification, are permitted", "This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY-NC 4.0",
             "\u212amit license \u0130 x", " ", "...", "a. apache\n \nlicensed under the license version 2 0", "long " * 30_000 + "released under the MIT\nlicense"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in license_scan.scanned(df).collect()}
    for i, t, _ in rows:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(p, label) for p in range(len(w)) for phrase, label in license_scan.PHRASES if w[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min((p for p, _ in hits), default=None), max((p for p, _ in hits), default=None))
        base = sorted({label for _, label in hits})
        assert r.base_labels == ",".join(base)
        method = set()
        for b in re.split(license_scan.BLOCK_END.replace(r"\z", r"\Z"), low):
            own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", b))
            hit = [(set(tpl.split()), label) for label, keys, tpl in license_scan.TEMPLATES if len(own & set(tpl.split())) >= license_scan.need(tpl) and set(keys.split()) <= own]
            method |= {label for s, label in hit if not any(s < other for other, _ in hit)}
        assert r.labels == ",".join(sorted(method | set(base))), (i, r.labels)
    assert got[11].labels == "bsd" and got[12].labels == "gpl,gpl-2.0" and got[13].labels == "cc-by,cc-by-nc-4.0"
    assert [r.n_words for r in license_scan.scanned(df.unionByName(df.where("doc_id = 8"))).where("doc_id = 8").collect()] == [got[8].n_words] * 2
    assert license_scan.scanned(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(corpus())
    size = defaultdict(int)
    for r in corpus():
        size[r[3]] += len(words(r[1]))
    target = mixing.source_targets(dict(size))
    assert abs(sum(target.values()) - min(mixing.SHARE * sum(size.values()), 2 * sum(size.values()))) < 1e-6
    for s in size:
        own = [r for r in rows if r.source == s]
        assert {r.source_size for r in own} == {size[s]} and all(r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r.size for r in own)
    again = mixing.mixed(docs.repartition(5)).collect()
    assert sorted(((r.doc_id, r.size, r.taken) for r in rows), key=key) == sorted(((r.doc_id, r.size, r.taken) for r in again), key=key)
    out = mixing.resampled(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mixed(empty).count() == 0


def test_mixing_flow_prefers_fresh_tokens():
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 12, "b": 12})
    used = defaultdict(int)
    for (p, _), n in flow.items():
        used[p] += n
    assert sum(used.values()) == 24 and used[("b",)] + used[("a", "b")] == 14
    assert used[("a",)] == 10 and sum(n for (_, s), n in flow.items() if s == "b") == 12


def test_mixing_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, ["a", "b"] if i % 3 else ["a"]) for i in range(60)], "doc_id long, text string, source array<string>")
    rows = mixing.mixed(df).collect()
    assert len(rows) == 60 and all(r.taken <= 20 for r in rows)


def test_language_id(spark, docs, empty):
    r = random.Random(1)
    text = {"aa": "the of and that with", "bb": "der die und nicht mit", "cc": "le la et que dans"}
    rows = [(i, " ".join(r.choices(text[g].split(), k=12)), g) for i in range(90) for g in [list(text)[i % 3]]]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !", None), (902, "unddie thewith", None)], "doc_id long, text string, lang string")
    model = language_id.fit(df, "lang", "text", F.col("doc_id") % 2 == 0, F.xxhash64("doc_id"))
    got = {x.doc_id: x for x in language_id.identified(df, model).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and got[902].lang_pred in text
    assert all(0 <= x.score <= 1 for x in got.values())
    none = language_id.fit(empty, "lang", "text", F.lit(True), F.xxhash64("doc_id"))
    assert language_id.identified(empty, none).count() == 0
    assert {x.lang_pred for x in language_id.identified(docs, none).collect()} == {"und"}


def test_toxicity(spark, empty):
    r = random.Random(2)
    vocab = ["".join(r.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(300):
        w, bad = [r.choice(vocab) for _ in range(60)], i % 5 == 0
        if bad:
            for j in range(10, 14):
                w[j] = r.choice(["zzap", "qquix", "wwolf"])
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame([*[x[:2] for x in rows], (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows if x[0] % 3], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, "doc_id", "text", F.lit(True))
    got = {x.doc_id: x for x in toxicity.scored(df, model).collect()}
    assert sum(got[i].predicted != y for i, _, y in rows) <= 3
    bad = next(got[i] for i, _, y in rows if y and got[i].passages)
    assert bad.passages[0].first <= 10 and bad.passages[0].end >= 13
    assert got[900].predicted == got[901].predicted == 0
    assert toxicity.clean(df, model).count() == sum(x.predicted == 0 for x in got.values())
    assert toxicity.scored(empty, model).count() == 0


def test_maximal_segments_against_all_spans():
    r = random.Random(5)
    for _ in range(200):
        s = [r.choice([-3, -2, -1, 1, 2, 4]) for _ in range(r.randint(1, 12))]

        def split(a, b):
            """Ruzzo and Tompa's definition: the best span (leftmost, shortest), then both sides."""
            best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            return [] if best is None or best[0] <= 0 else [*split(a, best[3]), (best[3], best[4], best[0]), *split(best[4], b)]

        import numpy as np

        got = toxicity.maximal_segments(np.arange(len(s)), np.array(s, float), 0.5)
        assert sum(x[2] for x in got) == sum(x[2] for x in split(0, len(s)))


def test_sentencepiece(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_dropout.MODEL)
    texts = [r[1] or "" for r in corpus()] + ["▁ a ▁▁", "日本 \U0001f600 x\x00y", " lead  and trail  "]
    plain = sentencepiece_dropout.Encoder(dropout=0.0)
    for x, ids in zip(texts, plain.encode(texts, [0] * len(texts)), strict=True):
        assert plain.decode(ids.tolist()) == x
        assert "▁" in x or ids.tolist() == sp.encode(x)
    rows = sentencepiece_dropout.encoded(docs).collect()
    assert all(r.lossless for r in rows) and len(rows) == len(corpus())
    again = sentencepiece_dropout.encoded(docs.repartition(2)).collect()
    assert sorted(str((r.doc_id, r.ids)) for r in rows) == sorted(str((r.doc_id, r.ids)) for r in again)
    other = sentencepiece_dropout.encoded(docs, seed=1).collect()
    assert sorted(str(r.ids) for r in rows) != sorted(str(r.ids) for r in other)
    v = plain.v
    units = ["▁" + "".join(random.Random(i).choices("abcdeé☃", k=i % 30 + 1)) for i in range(200)]
    keys = [random.Random(u).getrandbits(64) for u in units]
    assert sentencepiece_dropout.segment_many(v, units, keys, 0.3) == [sentencepiece_dropout.segment_agenda(v, u, k, 0.3) for u, k in zip(units, keys, strict=True)]
    assert sentencepiece_dropout.encoded(empty).count() == 0


def test_html_extraction(spark):
    page = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">one</a></li></ul></nav>'
            '<div class="ad">Buy this.</div><article><h1>Title &amp; more</h1><p><b>First  words\nhere, in a longer paragraph of text.<br><p>Second &lt;b&gt; paragraph, it goes on.</p></article>'
            '<div class="comments"><div class="comment"><p>Nice one.</p></div></div><form>Your name <input></form><footer>&copy; site</footer></body></html>')
    df = spark.createDataFrame([(1, "u", page, 9), (2, None, None, 9), (3, "v", "", 9), (1, "u", page, 9), (4, "w", "<p", 9)], "page_id long, url string, html string, text long")
    got = html_extraction.extracted(df).collect()
    want = "Title & more\nFirst words here, in a longer paragraph of text.\nSecond <b> paragraph, it goes on."
    assert sorted((r.page_id, r.text) for r in got if r.page_id < 4) == [(1, want), (1, want), (2, ""), (3, "")]
    assert all(r.n_chars == len(r.text) for r in got)
    r, model, wrong = random.Random(77), html_extraction.trained(), 0
    for _ in range(100):
        p = html_extraction.page(r)
        want = [t.replace("\x01", "") for _, t in html_extraction.parse(p)[1] if "\x01" in t]
        wrong += html_extraction.extract(model, [p.replace("\x01", "")])[0] != "\n".join(want)
    assert wrong <= 5


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefg") for _ in range(5)) for _ in range(500)]
    rows, labels = [], []
    for i in range(120):
        w = [r.choice(vocab) for _ in range(80)]
        if i % 6 == 0:
            w[5:9] = ["zzap", "qquix", "wwolf", "zzap"]
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(i % 6 == 0)))
    clean = [x for x in rows if x[0] % 6]
    rows += [(1000 + j, clean[j][1].replace(" ", "  "), "en", "s0", 1) for j in range(5)]
    rows += [(2000 + j, clean[j][1] + " extra", "en", "s0", 1) for j in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append(sorted({x.doc_id for x in docs.select("doc_id").collect()}))
    ids = {x[0] for x in clean}
    assert left[0] == sorted(ids | set(range(1000, 1005)) | set(range(2000, 2005)))
    assert left[1] == sorted(ids | set(range(2000, 2005)))
    assert left[2] == sorted(ids)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == docs.count() and all(x.lossless for x in out)


def test_training_rule():
    from pyspark.sql import SparkSession

    from terrano.llm.common import kept_out

    spark = SparkSession.getActiveSession()
    rows = spark.range(50).select("id", kept_out(F.col("id"), 5, 0).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
