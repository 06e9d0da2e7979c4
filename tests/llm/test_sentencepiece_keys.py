"""Every occurrence of a word, and every repetition of a document, has its own merge-dropout."""

from __future__ import annotations

import random

import numpy as np

from terrano.llm import sentencepiece_dropout as s


def spelled(e, ids):
    """The token ids of every unit of a text of equal words."""
    out = []
    for i in ids:
        piece = e.v.out[i]
        if piece.startswith(b" "):
            out.append([])
        out[-1].append(i)
    return {tuple(x) for x in out}


def test_occurrences_vary_within_a_document():
    e = s.Encoder(dropout=0.3)
    (ids,) = e.encode(["understanding " * 400], [7])
    assert e.decode(ids.tolist()) == "understanding " * 400
    assert len(spelled(e, ids.tolist())) > 10  # one segmentation for all before


def test_repeated_rows_vary(spark):
    text = "some words that are long enough to be cut differently " * 20
    df = spark.createDataFrame([(1, text)] * 6 + [(2, text), (None, text), (None, text), (3, None), (3, None)], "doc_id long, text string")
    rows = s.encoded(df).collect()
    assert len({tuple(r.ids) for r in rows if r.ids}) == 9 and all(r.lossless for r in rows)
    assert sorted(r.variant for r in rows if r.doc_id == 1) == list(range(6))
    again = s.encoded(df.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_frequent_units_against_the_agenda():
    v, r = s.vocabulary(s.MODEL), random.Random(5)
    odd = ["".join(r.choices("abcdeé☃ñ日\U0001f600x", k=r.randint(1, 60))) for _ in range(400)]
    units = [r.choice(["▁the", "▁understanding", "a☃b", "▁" + "x" * 60, "▁▁▁", *odd]) for _ in range(3000)]
    keys = [r.getrandbits(64) for _ in units]
    for p in (0.0, 0.2, 0.9):
        memory = s.Memory(v, p)
        for a in (0, 1500):  # the second half meets units that are remembered already
            ids, size = memory.segmented(units[a : a + 1500], np.array(keys[a : a + 1500], dtype=np.uint64))
            got = [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
            assert got == [s.segment_agenda(v, u, k, p) for u, k in zip(units[a : a + 1500], keys[a : a + 1500], strict=True)]


def test_rate_of_dropout():
    """A merge without alternatives is skipped as often as dropout says, and each occurrence on its own."""
    v = s.vocabulary(s.MODEL)
    units = ["▁a"] * 20_000
    ids, size = s.Memory(v, 0.1).segmented(units, s.mix(np.arange(20_000, dtype=np.uint64)))
    assert abs((size == 2).mean() - 0.1) < 0.01


def test_pair_table():
    v, r = s.vocabulary(s.MODEL), random.Random(3)
    pairs = [divmod(k, v.size) for k in r.sample(list(v.pairs), 5000)] + [(r.randrange(v.size), r.randrange(v.size)) for _ in range(5000)] + [(-1, 5), (5, -1)]
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    want = [v.pairs.get(x * v.size + y, s._NONE) if x >= 0 and y >= 0 else s._NONE for x, y in pairs]
    assert v.ranks(a, b).tolist() == want


def test_a_task_remembers_little():
    e = s.Encoder()
    for k in range(12):
        words = " ".join(f"w{k}x{j}" for j in range(20_000))
        e.encode([words], np.array([k]))
    m = e.memory
    assert len(m.known) <= 200_000 and sum(8 * len(x) for x in (m.spans, m.span_off, m.id_off)) + 4 * len(m.ids) < 24 << 20
