"""Super-k-mers of frequent words, equality by bytes, repeated rows, settled blocks."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from terrano.llm import substring_dedup as d
from terrano.llm.textvec import windows

from .test_brute_force import words


def test_minimiser_is_a_function_of_the_window():
    r = np.random.default_rng(1)
    vocab = d.mix(np.arange(40, dtype=np.uint64))
    h = vocab[np.minimum(r.geometric(0.15, 4000) - 1, 39)]
    rank = np.zeros(1 << d.SKETCH, np.uint8)
    for i in range(30):  # most words are frequent
        rank[int(vocab[i] >> np.uint64(64 - d.SKETCH))] = 1 + i % 5
    first = np.array([0, 1000, 1005, 4000])
    start, n, low = d.super_kmers(h, first, rank)
    got = {int(s) + j: int(v) for s, c, v in zip(start, n, low, strict=True) for j in range(c)}
    at, _ = windows(h, first, d.WINDOW)
    assert sorted(got) == at.tolist()
    seen = {}
    for a in at.tolist():
        assert seen.setdefault(tuple(h[a : a + 13].tolist()), got[a]) == got[a]
    assert len({v >> 63 for v in got.values()}) == 2  # both kinds of minimisers


def test_frequent_words_and_repeated_rows(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(25)]
    rows = []
    for i in range(120):
        w = [r.choice(vocab) for _ in range(r.randint(5, 60))]
        if i % 3 == 0:
            w[2:2] = ("one passage that a third of all documents share word by word " * 2).split()
        rows.append((i, "  ".join(w)))
    rows += [rows[30]] * 20 + [(None, rows[3][1])] * 5 + [(5, "a second text of a repeated id " + rows[6][1])]
    big = 1 << 62
    least = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - 12):
            g = tuple(w[a : a + 13])
            least[g] = min(least.get(g, big), big if i is None else i)
    want = []
    for i, t in rows:
        w, gone = words(t), set()
        for a in range(len(w) - 12):
            if least[tuple(w[a : a + 13])] < (big if i is None else i):
                gone.update(range(a, a + 13))
        want.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for a, x in enumerate(w) if a not in gone).encode()).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(str(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in d.deduplicated(df, texts=False).collect()]
    assert Counter(got) == Counter(want)


def test_blocks_and_bytes():
    cols = np.array([[1, -5, 0, 13], [d._NULL, 7, 2, 99]])
    assert np.stack(d._decode_ranges(d._encode_ranges(cols)), axis=1).tolist() == cols.tolist()
    data = np.frombuffer(b"abcabcabd", np.uint8)
    assert d.same_bytes(data, np.array([0, 0, 3]), np.array([3, 6, 6]), np.array([3, 3, 2]), limit=2).tolist() == [True, False, True]
