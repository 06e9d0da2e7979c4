"""The Jaccard join where keys clash, lists are crowded, ids repeat; and which row of a component stays."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from terrano.llm import jaccard_join

from .test_brute_force import SCHEMA, corpus, key, words


def components(rows, k, t):
    """Component number of each row, by comparing all pairs."""
    sets = []
    for r in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(r[1])]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= t * len(a | sets[j]):
                root[find(i)] = find(j)
    return [find(i) if sets[i] else None for i in range(len(sets))]


def crowd(n=60):
    """Texts that share a passage with many others, some of them near copies."""
    r = random.Random(8)
    vocab = ["w" + str(i) for i in range(3000)]
    shared = [" ".join(r.choice(vocab) for _ in range(25)) for _ in range(3)]
    rows = []
    for i in range(n):
        w = " ".join(r.choice(vocab) for _ in range(r.choice([10, 30, 80])))
        text = f"{w} {r.choice(shared)} {r.choice(shared)}"
        rows.append((i, text))
        if i % 7 == 0:
            rows.append((1000 + i, text + " more"))
    return [(i, t, "en", "s", 1, 1, 1, 1, "t", 1) for i, t in rows]


@pytest.mark.parametrize("key_bits,crowded", [(3, 10**9), (64, 2)])
def test_clashing_keys_and_crowded_lists(spark, monkeypatch, key_bits, crowded):
    monkeypatch.setattr(jaccard_join, "CROWD", crowded)
    monkeypatch.setattr(jaccard_join, "WORTH", 0)
    monkeypatch.setattr(jaccard_join, "MAX_ROUNDS", 1)
    for rows, k, t in ((corpus(), 3, 90), (crowd(), 3, 80)):
        comp = components(rows, k, t)
        ids = defaultdict(list)
        for c, r in zip(comp, rows, strict=True):
            ids[c].append(r[0])
        want = [(r[0], r[0] if c is None else min((x for x in ids[c] if x is not None), default=None)) for c, r in zip(comp, rows, strict=True)]
        got = jaccard_join.linked_rows(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, t=t, key_bits=key_bits).collect()
        assert sorted(((r.doc_id, r.component_id) for r in got), key=key) == sorted(want, key=key)


def test_one_of_each(spark):
    rows = corpus()
    base = rows[-1][1]
    long_ = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows += [(500, long_, *rows[0][2:]), (501, long_ + " x", *rows[0][2:]), (501, "an unrelated text of one repeated id", *rows[0][2:]), (None, "only null ids here to see", *rows[0][2:]), (None, "only null ids here to  see", *rows[0][2:])]
    assert base is not None
    comp = components(rows, 5, 80)
    best = {}
    for c, r in zip(comp, rows, strict=True):
        if c is not None:
            best[c] = min(best.get(c, (True, 0)), (r[0] is None, r[0] or 0))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = jaccard_join.one_of_each(df)
    assert out.columns == df.columns
    got = [tuple(r) for r in out.collect()]
    # every component once, by a row of its least id; texts without words once for each id
    at = {(r[0], r[1]): c for c, r in zip(comp, rows, strict=True)}
    kept = Counter(at[r[0], r[1]] for r in got if at[r[0], r[1]] is not None)
    assert set(kept) == {c for c in comp if c is not None} and set(kept.values()) == {1}
    assert all((r[0] is None, r[0] or 0) == best[at[r[0], r[1]]] for r in got if at[r[0], r[1]] is not None)
    blank = {(r[0], r[1]) for c, r in zip(comp, rows, strict=True) if c is None}
    assert sorted(((r[0], r[1]) for r in got if at[r[0], r[1]] is None), key=key) == sorted(blank, key=key)
    assert all(r in rows for r in got)
    assert jaccard_join.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0
