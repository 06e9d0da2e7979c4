"""Lower-cased letter words of texts on code points, vectorised like textvec."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .textvec import CHARS, mix, prefix, span, words

CHUNK = 1 << 18
_U = np.uint64


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(not a letter, hash) of each code point; all that are no letters hash alike."""
    other = ~np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    h = mix(np.arange(0x110000, dtype=_U) + _U(0x51ED)) | _U(1)
    h[other] = _U(0x9E3779B97F4A7C15)
    return other, h


class Letters:
    """The words of a run of texts: starts, ends (in code points), first word of each text, prefix hashes."""

    def __init__(self, texts: list[str]):
        other, table = tables()
        low = ["\n" + x.lower() for x in texts]
        self.off = np.concatenate(([0], np.cumsum([len(x) for x in low])))
        data = np.frombuffer(("".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.starts, self.ends, self.first = words(data[:-1], self.off, other)
        self.sums = prefix(table[data], CHARS)
        self.data = data

    def hashes(self) -> np.ndarray:
        return span(self.sums, self.starts, self.ends, CHARS)

    def heads(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(words longer than n letters, hash of their first n letters)."""
        at = np.flatnonzero(self.ends - self.starts > n)
        return at, span(self.sums, self.starts[at], self.starts[at] + n, CHARS)

    def grams(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into at, hash) of every n-gram of the words `at`, each with one mark before and after it."""
        a, z = self.starts[at] - 1, self.ends[at] + 1
        count = np.maximum(z - a - n + 1, 0)
        own = np.repeat(np.arange(len(at)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
        return own, span(self.sums, place, place + n, CHARS)


def runs(texts: pa.Array) -> Iterator[tuple[int, Letters]]:
    """(first row, Letters) for runs of rows of about CHUNK characters; null is empty."""
    rows = [x or "" for x in texts.to_pylist()]
    a = 0
    while a < len(rows):
        b, size = a, 0
        while b < len(rows) and (b == a or size + len(rows[b]) <= CHUNK):
            size += len(rows[b])
            b += 1
        yield a, Letters(rows[a:b])
        a = b


def lookup(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted keys, -1 without one."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)
