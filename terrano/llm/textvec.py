"""Vectorised text primitives shared by the Python-side operators.

Texts arrive as Arrow string arrays.  They are cut into chunks of about CHUNK bytes (one
longer document makes a chunk of its own), words are found on the raw UTF-8 bytes with numpy,
and every word gets a 64-bit hash from a prefix polynomial modulo 2**64, so no Python object
is made per word.  Memory is bounded by the chunk, not by the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_U = np.uint64


def _mix_scalar(x: int) -> int:
    x &= 2**64 - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 2**64 - 1
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 2**64 - 1
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE = np.array([_mix_scalar(0x9E3779B97F4A7C15 * (i + 1)) | 1 for i in range(256)], dtype=_U)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, extended on demand."""

    def __init__(self, seed: int):
        self.base = _mix_scalar(seed) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 64)
            for name, b in (("up", self.base), ("down", self.inverse)):
                step = np.full(size, _U(b))
                step[0] = 1
                setattr(self, name, np.cumprod(step, dtype=_U))
        return self.up[:n], self.down[:n]


CHARS, WORDS = Powers(0xA5), Powers(0x5A)


def prefix(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums from which span() takes the hash of any run of values."""
    up, _ = powers.get(len(values))
    out = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * up, dtype=_U, out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    _, down = powers.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about `limit` bytes; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and the first word of each text (one more entry at the end)."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(off), np.int64)
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span(prefix(BYTE[data], CHARS), starts, ends, CHARS)


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of each run of k words within one text."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    ok = np.ones(n - k + 1, dtype=bool)
    for j in range(1, k):  # a window must not reach the next text's first word
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < len(ok))]] = False
    start = np.flatnonzero(ok)
    return start, span(prefix(hashes, WORDS), start, start + k, WORDS)


def shingle_sets(texts: pa.Array, k: int, weight: np.ndarray | None = None) -> Iterator[tuple]:
    """(row, sorted distinct shingle hashes), A-Z lower-cased; fewer than k words: one shingle of all; none: empty.

    With weight, a table by the leading bits of a word's hash: also the sum of the words' weights of each shingle.
    """
    shift = _U(64 - (len(weight).bit_length() - 1)) if weight is not None else None
    for row, data, off in chunks(texts):
        low = LOWER[data]
        s, e, first = words(low, off)
        h = word_hashes(low, s, e)
        start, g = windows(h, first, k)
        if weight is not None:
            heavy = np.concatenate(([0], np.cumsum(weight[(h >> shift).astype(np.int64)], dtype=np.int64)))
            w = heavy[start + k] - heavy[start]
        bound = np.searchsorted(start, first)
        sums = None
        for i in range(len(off) - 1):
            a, b = bound[i], bound[i + 1]
            if b > a:
                if weight is None:
                    yield row + i, np.unique(g[a:b])
                else:
                    u, at = np.unique(g[a:b], return_index=True)
                    yield row + i, u, w[a + at]
                continue
            if first[i + 1] > first[i]:
                sums = prefix(h, WORDS) if sums is None else sums
                one = span(sums, first[i : i + 1], first[i + 1 : i + 2], WORDS)
            else:
                one = np.zeros(0, _U)
            yield (row + i, one) if weight is None else (row + i, one, np.zeros(len(one), np.int64))


def word_counts(texts: pa.Array, total: np.ndarray) -> None:
    """Adds every word, A-Z lower-cased, to the counter of its hash's leading bits."""
    shift = _U(64 - (len(total).bit_length() - 1))
    for _, data, off in chunks(texts):
        low = LOWER[data]
        s, e, _ = words(low, off)
        np.add.at(total, (word_hashes(low, s, e) >> shift).astype(np.int64), 1)
