"""SentencePiece encoding and decoding with seeded merge-dropout.

Merge-type (BPE) segmentation: symbols start as characters, and an agenda joins the adjacent pair
whose union is the best piece, leftmost first, until none is left.  With dropout p each
candidate merge is skipped if a keyed hash of (seed, document id and text, repetition, place of the
unit in the text, left start, middle, right end) falls below p, so every occurrence of a word is
cut on its own, and rows that repeat a document are cut anew; reruns agree, other seeds differ.
Characters without a piece become byte pieces, and so does a literal U+2581, so decoding gives
every text back.

A unit is a run of spaces with the characters up to the next space or line end; no piece of
the model reaches across units (checked on loading), so units are segmented on their own.  Of a
unit only what holds for every key is remembered: the candidates of its agenda without dropout, and
the ids it ends with.  An occurrence of which no candidate on that way is skipped ends with
these ids; every other occurrence runs its own agenda, many agendas at once, a step of each in a
step of numpy.
"""

from __future__ import annotations

import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed, numbered, prepare
from .textvec import _mix_scalar, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 29
#: Units, candidates and token ids that a task remembers; beyond any of them it starts afresh.
MEMORY = 150_000
CANDIDATES = 1_200_000
TOKENS = 1_500_000
#: Units that are looked up together, and symbols whose agendas run together.
STEP = 20_000
SYMBOLS = 1 << 16
#: Longer units take the agenda one by one and are not remembered.
LONG = 48
MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}\\n]*|\\n|[^{MARK}\\n]+")
_U = np.uint64
_NONE = np.int64(1) << 62
_MASK = 2**64 - 1
_START, _MIDDLE, _END = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


class Vocabulary:
    """Pieces of a BPE model file with byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        usual = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in usual}
        self.bytes = [0] * 256
        self.out: list[bytes] = [b""] * self.size
        for i in range(self.size):
            if sp.is_byte(i):
                self.bytes[b := int(sp.id_to_piece(i)[1:-1], 16)] = i
                self.out[i] = bytes([b])
        for p, i in self.ids.items():
            if re.search(f"[^{MARK}]{MARK}|\\n", p):
                raise ValueError("a piece reaches across units")
            self.out[i] = p.replace(MARK, " ").encode()
        # the best piece has the highest score; merges compare ranks
        order = sorted(usual, key=lambda i: (-sp.get_score(i), i))
        self.rank = np.zeros(self.size, dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.by_rank = np.array(order, dtype=np.int64)
        pairs = {}
        for p, i in self.ids.items():
            for j in range(1, len(p)):
                a, b = self.ids.get(p[:j]), self.ids.get(p[j:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = int(self.rank[i])
        self.pairs = pairs
        self.chars = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        self._fill(pairs)

    def _fill(self, pairs: dict[int, int]) -> None:
        """Two tables of slots, a key in either of its two places (cuckoo hashing), for lookups of many pairs at once."""
        bits = max(8, (4 * len(pairs)).bit_length())
        self.shift = _U(64 - bits)
        self.slot_keys, self.slot_ranks = np.full((2, 1 << bits), -1, dtype=np.int64), np.zeros((2, 1 << bits), dtype=np.int64)
        keys = np.array(list(pairs), dtype=np.int64)
        place = np.stack([(keys.astype(_U) * _U(m) >> self.shift).astype(np.int64) for m in (_START, _END)])
        table: list[dict[int, int]] = [{}, {}]
        for i in range(len(keys)):
            side, at = 0, i
            for _ in range(500):
                was = table[side].get(int(place[side, at]))
                table[side][int(place[side, at])] = at
                if was is None:
                    break
                side, at = 1 - side, was
            else:
                raise ValueError("the pair table is too small")
        for side in (0, 1):
            slots, at = np.array(list(table[side]), dtype=np.int64), np.array(list(table[side].values()), dtype=np.int64)
            if len(at):
                self.slot_keys[side, slots] = keys[at]
                self.slot_ranks[side, slots] = [pairs[int(k)] for k in keys[at]]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair of symbols makes, _NONE without one."""
        key = a.astype(np.int64) * self.size + b
        key[(a < 0) | (b < 0)] = -2
        out = np.full(len(key), _NONE)
        for side, m in enumerate((_START, _END)):
            slot = (key.view(_U) * _U(m) >> self.shift).astype(np.int64)
            hit = np.flatnonzero(self.slot_keys[side, slot] == key)
            out[hit] = self.slot_ranks[side, slot[hit]]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _skipped(key: int, span: int, p: float) -> bool:
    """Whether the keyed hash skips the candidate of a span; _skips() does the same on arrays."""
    return _mix_scalar(key ^ span) >> 11 < p * 2.0**53


def _skips(keys: np.ndarray, spans: np.ndarray, p: float) -> np.ndarray:
    return (mix(keys ^ spans) >> _U(11)).astype(np.float64) < p * 2.0**53


def _span(start: int, middle: int, end: int) -> int:
    return (start * _START + middle * _MIDDLE + end * _END) & _MASK


def segment_agenda(v: Vocabulary, unit: str, key: int, p: float) -> list[int]:
    """The ids of one unit by the agenda itself; unknown characters as bytes."""
    sym = [v.ids.get(c, -1) for c in unit]
    end = list(range(1, len(unit) + 1))
    left, right = list(range(-1, len(unit) - 1)), list(range(1, len(unit) + 1))
    heap: list = []

    def offer(a):
        b = right[a] if a >= 0 else len(unit)
        if a >= 0 and b < len(unit) and sym[a] >= 0 and sym[b] >= 0:
            r = v.pairs.get(sym[a] * v.size + sym[b])
            if r is not None:
                heapq.heappush(heap, (r, a, end[a], end[b]))

    for a in range(len(unit) - 1):
        offer(a)
    alive = [True] * len(unit)
    while heap:
        r, a, m, e = heapq.heappop(heap)
        b = right[a] if alive[a] else len(unit)
        if not alive[a] or end[a] != m or b >= len(unit) or end[b] != e:
            continue
        if p > 0 and _skipped(key, _span(a, m, e), p):
            continue
        sym[a], end[a], alive[b] = int(v.by_rank[r]), e, False
        right[a] = right[b]
        if right[a] < len(unit):
            left[right[a]] = a
        offer(a)
        offer(left[a])
    out, a = [], 0
    while a < len(unit):
        out += [sym[a]] if sym[a] >= 0 else [v.bytes[x] for x in unit[a].encode("utf-8", "surrogatepass")]
        a = right[a]
    return out


def _ragged(off: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, sizes) of the runs `pick` of a flat array with offsets."""
    size = off[pick + 1] - off[pick]
    return np.repeat(off[pick] - (np.cumsum(size) - size), size) + np.arange(int(size.sum())), size


def agendas(v: Vocabulary, units: list[str], keys: np.ndarray, p: float, candidates: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """segment_agenda() of many non-empty units: (ids, offsets by unit, spans of all candidates, offsets by unit).

    All symbols stand one after the other; each round takes the best candidate of every unit.
    Spans are gathered only if `candidates` is set.
    """
    size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    off = np.concatenate(([0], np.cumsum(size)))
    sym, owner = v.chars[code].astype(np.int64), np.arange(len(units))
    start = np.arange(len(code)) - np.repeat(off[:-1], size)
    end = start + 1
    rank = np.full(len(sym), _NONE)
    rank[:-1] = v.ranks(sym[:-1], sym[1:])
    rank[off[1:] - 1] = _NONE
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    spans: list[tuple[np.ndarray, np.ndarray]] = []
    while len(owner):
        low = np.minimum.reduceat(rank, off[:-1])
        live = low < _NONE
        if 2 * live.sum() <= len(owner):  # what is finished goes
            stay = np.repeat(live, np.diff(off))
            out = ~stay
            done.append((np.repeat(owner[~live], np.diff(off)[~live]), sym[out], start[out]))
            sym, start, end, rank = sym[stay], start[stay], end[stay], rank[stay]
            off = np.concatenate(([0], np.cumsum(np.diff(off)[live])))
            owner, low = owner[live], low[live]
            live = np.ones(len(owner), dtype=bool)
            if not len(owner):
                break
        # the leftmost place of each unit that holds its least rank
        match = np.flatnonzero(rank == np.repeat(np.where(live, low, -1), np.diff(off)))
        at = match[np.searchsorted(match, off[:-1][live])]
        low = low[live]
        span = start[at].astype(_U) * _U(_START) + end[at].astype(_U) * _U(_MIDDLE) + end[at + 1].astype(_U) * _U(_END)
        if candidates:
            spans.append((owner[live], span))
        skip = _skips(keys[owner[live]], span, p) if p > 0 else np.zeros(len(at), dtype=bool)
        rank[at[skip]] = _NONE
        go = at[~skip]
        sym[go], end[go] = v.by_rank[low[~skip]], end[go + 1]
        stay = np.ones(len(sym), dtype=bool)
        stay[go + 1] = False
        gone = np.zeros(len(owner), dtype=np.int64)
        gone[np.flatnonzero(live)[~skip]] = 1
        go = go - (np.cumsum(gone)[np.flatnonzero(live)[~skip]] - 1)
        sym, start, end, rank = sym[stay], start[stay], end[stay], rank[stay]
        off = off - np.concatenate(([0], np.cumsum(gone)))
        first, last = np.zeros(len(sym) + 1, dtype=bool), np.zeros(len(sym) + 1, dtype=bool)
        first[off[:-1]] = True
        last[off[1:] - 1] = True
        rank[go] = _NONE
        more = go[~last[go]]
        rank[more] = v.ranks(sym[more], sym[more + 1])
        more = go[~first[go]] - 1
        rank[more] = v.ranks(sym[more], sym[more + 1])
    own, ids, at = (np.concatenate([x[i] for x in done]) if done else np.zeros(0, np.int64) for i in range(3))
    order = np.argsort(own, kind="stable")
    own, ids, at = own[order], ids[order], at[order]
    bad = np.flatnonzero(ids < 0)
    if len(bad):  # characters without a piece: their bytes
        c = code[np.concatenate(([0], np.cumsum(size)))[own[bad]] + at[bad]]
        many = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        times = np.ones(len(ids), dtype=np.int64)
        times[bad] = many
        own, ids = np.repeat(own, times), np.repeat(ids, times)
        c, many = np.repeat(c, many), np.repeat(many, many)
        j = np.arange(len(c)) - np.flatnonzero(np.concatenate(([True], np.repeat(np.arange(len(bad)), times[bad])[1:] != np.repeat(np.arange(len(bad)), times[bad])[:-1])))[np.repeat(np.arange(len(bad)), times[bad])]
        tail = 0x80 | (c >> (6 * (many - 1 - j)) & 0x3F)
        head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[many] | c >> (6 * (many - 1))
        ids[ids < 0] = np.array(v.bytes, dtype=np.int64)[np.where(many == 1, c, np.where(j == 0, head, tail))]
    ends = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(units)))))
    who, found = (np.concatenate([x[i] for x in spans]) if spans else np.zeros(0, t) for i, t in ((0, np.int64), (1, _U)))
    order = np.argsort(who, kind="stable")
    return ids.astype(np.int32), ends, found[order], np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(units)))))


class Memory:
    """Units that were met: their ids and candidates without dropout, which hold for any document."""

    def __init__(self, v: Vocabulary, p: float):
        self.v, self.p = v, p
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.id_off = array("i"), array("q", [0])
        self.spans, self.span_off = array("Q"), array("q", [0])

    def full(self) -> bool:
        return len(self.known) > MEMORY or len(self.spans) > CANDIDATES or len(self.ids) > TOKENS

    def learn(self, units: list[str]) -> None:
        ids, ends, spans, span_ends = agendas(self.v, units, np.zeros(0, _U), 0.0, candidates=True)
        for flat, off, new, cut in ((self.ids, self.id_off, ids, ends), (self.spans, self.span_off, spans, span_ends)):
            off.frombytes((cut[1:] + len(flat)).astype("<i8").tobytes())
            flat.frombytes(new.tobytes())
        for u in units:
            self.known[u] = len(self.known)

    def segmented(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units one after the other, each by its key, and how many each has."""
        if self.full():
            self.clear()
        known = self.known
        at = np.array([known.get(u, -1) for u in units], dtype=np.int64)
        new = dict.fromkeys(units[i] for i in np.flatnonzero(at < 0).tolist() if len(units[i]) <= LONG)
        if new:
            self.learn(list(new))
            for i in np.flatnonzero(at < 0).tolist():
                at[i] = known.get(units[i], -1)
        plain = np.flatnonzero(at >= 0)
        spans, span_off = np.frombuffer(self.spans, dtype=_U), np.frombuffer(self.span_off, dtype=np.int64)
        own = np.zeros(0, dtype=np.int64)
        if self.p > 0:
            places, many = _ragged(span_off, at[plain])
            hit = _skips(np.repeat(keys[plain], many), spans[places], self.p)
            own = plain[np.unique(np.repeat(np.arange(len(plain)), many)[hit])]
        plain = np.setdiff1d(plain, own, assume_unique=True)
        ids, id_off = np.frombuffer(self.ids, dtype=np.int32), np.frombuffer(self.id_off, dtype=np.int64)
        places, many = _ragged(id_off, at[plain])
        found = [(plain, ids[places], many)]
        del ids, id_off, spans, span_off  # the tables cannot grow under a view
        weight = np.cumsum([len(units[i]) for i in own.tolist()])
        for part in np.split(own, np.flatnonzero(np.diff(weight // SYMBOLS)) + 1) if len(own) else []:
            got, ends, _, _ = agendas(self.v, [units[i] for i in part.tolist()], keys[part], self.p)
            found.append((part, got, np.diff(ends)))
        for i in np.flatnonzero(at < 0).tolist():
            got = np.array(segment_agenda(self.v, units[i], int(keys[i]), self.p), dtype=np.int32)
            found.append((np.array([i]), got, np.array([len(got)])))
        size = np.zeros(len(units), dtype=np.int64)
        for part, _, many in found:
            size[part] = many
        off = np.concatenate(([0], np.cumsum(size)))
        out = np.zeros(int(off[-1]), dtype=np.int32)
        for part, got, _ in found:
            out[_ragged(off, part)[0]] = got
        return out, size


def segment_many(v: Vocabulary, units: list[str], keys: list[int], p: float) -> list[list[int]]:
    """segment_agenda() of many units at once."""
    ids, size = Memory(v, p).segmented(units, np.array(keys, dtype=_U))
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] if units else []


class Encoder:
    """Encodes and decodes texts."""

    def __init__(self, path: str = MODEL, dropout: float = DROPOUT):
        self.v = vocabulary(path)
        self.memory = Memory(self.v, dropout)

    def units(self, text: str) -> list[str]:
        # a literal mark is no space: an empty unit stands for it
        if MARK not in text:
            return UNIT.findall(MARK + text.replace(" ", MARK)) if text else []
        parts = text.split(MARK)
        out = UNIT.findall(MARK + parts[0].replace(" ", MARK))
        for x in parts[1:]:
            out.append("")
            out += UNIT.findall(x.replace(" ", MARK))
        return out

    def encode(self, texts: list[str], keys) -> list[np.ndarray]:
        """Ids of each text; keys are those of the rows, from which each place in a text has its own."""
        split = [self.units(x) for x in texts]
        n = np.array([len(x) for x in split], dtype=np.int64)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        own = mix(np.repeat(np.asarray(keys).astype(_U), n) + (place + 1).astype(_U) * _U(_START))
        flat = [u for x in split for u in x]
        ids, size = [], []
        for a in range(0, len(flat), STEP):
            got, many = self._segmented(flat[a : a + STEP], own[a : a + STEP])
            ids.append(got)
            size.append(many)
        ids, size = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((ids, np.int32), (size, np.int64)))
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(n)]
        return np.split(ids, ends[:-1]) if texts else []

    def _segmented(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if "" not in units:
            return self.memory.segmented(units, keys)
        # an empty unit stands for a literal mark: its bytes
        mark = np.array([self.v.bytes[b] for b in MARK.encode()], dtype=np.int32)
        is_mark = np.array([not u for u in units])
        got, many = self.memory.segmented([u for u in units if u], keys[~is_mark])
        size = np.full(len(units), len(mark), dtype=np.int64)
        size[~is_mark] = many
        off = np.concatenate(([0], np.cumsum(size)))
        out = np.zeros(int(off[-1]), dtype=np.int32)
        out[_ragged(off, np.flatnonzero(~is_mark))[0]] = got
        out[_ragged(off, np.flatnonzero(is_mark))[0]] = np.tile(mark, int(is_mark.sum()))
        return out, size

    def decode(self, ids) -> str:
        out = self.v.out
        return b"".join([out[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, variant, ids, n_tokens, lossless (whether decoding gives the text back).

    Null and empty texts have no ids.  variant numbers the rows of equal id and text, and each has its
    own segmentation.  Only if an id repeats are rows dealt out to number them.  Other columns are not
    read, whatever their names.  An empty table gives an empty result.  path is read by every executor.
    """
    prepare(docs.sparkSession)
    if docs.groupBy(id_col).count().where("count > 1").take(1):
        freed(docs.sparkSession)  # dealing out the texts takes room
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("i"), F.col(id_col).isNull().alias("none"), F.xxhash64(text_col).alias("h"))
        rows = numbered(rows, ["i", "none", "h"], "variant").select("doc_id", "variant", "text")
    else:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).alias("variant"), F.col(text_col).alias("text"))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"), "variant"))

    def each(it):
        e = Encoder(path, dropout)
        for b in it:
            for a in range(0, b.num_rows, 50):
                part = b.slice(a, 50)
                texts = [x or "" for x in part.column(2).to_pylist()]
                ids = e.encode(texts, part.column(3).to_numpy())
                same = [e.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
                off = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())), pa.array(np.diff(off), pa.int32()), pa.array(same, pa.bool_())],
                    names=["doc_id", "variant", "ids", "n_tokens", "lossless"])

    return rows.mapInArrow(each, "doc_id long, variant int, ids array<int>, n_tokens int, lossless boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encoded() over documents; null, empty and repeated rows as stated there."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
