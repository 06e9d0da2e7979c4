"""Substring dedup by super-k-mer partitioning.

A window is 13 consecutive words.  Its minimiser is the least hash of its words that are not
frequent; a window of frequent words alone has the least of its three-word runs, those of
rarer words first.  So a frequent word does not draw its windows into one bucket: what counts as frequent follows
the number of buckets, by a fixed-size count sketch of all text.  Consecutive windows with one minimiser
travel together as one packed string (their words, joined by a space) to the minimiser's bucket,
many strings of a task in one compressed block.  In the bucket the windows are sorted by two hashes,
equal neighbours are compared byte by byte, and each window that also starts in a document
with a smaller id is marked; marks come back as word ranges.

Hot passages: equal strings of one task are settled there, where only the one of the smallest id
travels on, so a passage of a third of all documents reaches its bucket once a task; the settled ranges
travel in packed blocks of bounded size, dealt out evenly.  The number of buckets follows the input, so
a bucket keeps its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_SCHEMA, MEMBERS, emit_blocks, empty_to_string, is_member, member_bits, parts, prepare, stored, sum_blocks
from .textvec import SPACE, WORDS, chunks, mix, prefix, span, windows, word_hashes, words

WINDOW = 13
#: Words of a run that stands for a window of frequent words.
MGRAM = 3
SKETCH = 20
#: Bytes of packed strings that a task gathers before it sends blocks.
FLUSH = 12 << 20
#: Buckets for each partition of the input.
SPREAD = 16
#: A word is frequent if its counter holds more than this share of a bucket's words: up to 25 words travel for each of its places.
SHARE = 1 / 32
#: Settled ranges in one block.
SETTLED = 20_000
_U = np.uint64
_NULL = np.iinfo(np.int64).max


def heavy_ranks(docs: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """By counter of the sketch: 0 for words that are not frequent, else 1 and more with the logarithm of the count, over all text."""

    def count(it):
        from pyspark import TaskContext

        total = np.zeros(1 << SKETCH, dtype=np.uint32)
        for b in it:
            for _, data, off in chunks(b.column(0)):
                s, e, _ = words(data, off)
                total += np.bincount((word_hashes(data, s, e) >> _U(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH).astype(np.uint32)
        yield from emit_blocks(total, TaskContext.get().partitionId())

    total = sum_blocks(docs.sparkSession, docs.select(text_col).mapInArrow(count, BLOCK_SCHEMA), 1 << SKETCH, docs.rdd.getNumPartitions())
    limit = max(8.0, float(total.sum()) * SHARE / buckets)
    return np.where(total > limit, np.minimum(1 + np.log2(np.maximum(total / limit, 1)), 31), 0).astype(np.uint8)


def packed(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes with each run of white space as one space, and the words' places in them."""
    white = SPACE[data]
    keep = ~white
    keep[1:] |= white[1:] & ~white[:-1]
    at = np.cumsum(keep) - 1
    return np.where(white, np.uint8(32), data)[keep].tobytes(), at[s], at[e - 1] + 1


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w successive values; twice as many with each step."""
    size = 1
    while size < w:
        step = min(size, w - size)
        v = np.minimum(v[: len(v) - step], v[step:])
        size += step
    return v


def super_kmers(h: np.ndarray, first: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, minimiser) of each run of windows with one minimiser."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    if len(h) < WINDOW:
        return none
    start, _ = windows(h, first, WINDOW)
    if not len(start):
        return none
    heavy = rank[(h >> _U(64 - SKETCH)).astype(np.int64)]
    top = _U(1 << 63)
    low = _least(np.where(heavy == 0, mix(h) >> _U(1), top), WINDOW)[start]
    if (low == top).any():
        at = np.arange(len(h) - MGRAM + 1)
        v = span(prefix(h, WORDS), at, at + MGRAM, WORDS)
        v = top | (_least(heavy, MGRAM).astype(_U) << _U(58)) | (mix(v) >> _U(6))
        low = np.where(low == top, _least(v, WINDOW - MGRAM + 1)[start], low)
    cut = np.flatnonzero((np.diff(start) != 1) | (low[1:] != low[:-1])) + 1
    begin = np.concatenate(([0], cut))
    return start[begin], np.diff(np.concatenate((begin, [len(start)]))), low[begin]


RANGES = "doc_id long, h long, s int, e int"


def _encode(items: list) -> bytes:
    """items: (string, id order, row hash, first word)."""
    head = np.array([len(items)], "<i4").tobytes()
    cols = [np.array([x[i] for x in items], kind).tobytes() for i, kind in ((1, "<i8"), (2, "<i8"), (3, "<i4"))]
    text = b"\n".join(x[0] for x in items)
    return pa.compress(head + b"".join(cols) + text, codec="zstd", asbytes=True)


def _decode(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    size = int.from_bytes(blob[:4], "little")
    raw = pa.decompress(blob[4:], decompressed_size=size, codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    a = 4
    ids = np.frombuffer(raw, "<i8", n, a)
    hs = np.frombuffer(raw, "<i8", n, a + 8 * n)
    starts = np.frombuffer(raw, "<i4", n, a + 16 * n)
    return ids, hs, starts, raw[a + 20 * n :]


def _encode_ranges(cols: np.ndarray) -> bytes:
    """Rows (id order, row hash, first word, end word)."""
    raw = b"".join(cols[:, i].astype(kind).tobytes() for i, kind in enumerate(("<i8", "<i8", "<i4", "<i4")))
    return len(cols).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _decode_ranges(blob: bytes) -> tuple[np.ndarray, ...]:
    n = int.from_bytes(blob[:4], "little")
    raw = pa.decompress(blob[4:], decompressed_size=24 * n, codec="zstd", asbytes=True)
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "<i4", n, 16 * n), np.frombuffer(raw, "<i4", n, 20 * n)


def scattered(docs: DataFrame, buckets: int, rank: np.ndarray) -> DataFrame:
    """(bucket, blob) of a table (doc_id, h, t): super-k-mers for their bucket; below 0: ranges that are settled already."""
    rank = docs.sparkSession.sparkContext.broadcast(rank)

    def flush(best: dict, again: set, settled: list, sent: int) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        by: dict[int, list] = {}
        for text, (bucket, order, h, start, _) in best.items():
            by.setdefault(bucket, []).append((text, order, h, start))
        for bucket, *item in sorted(again):
            by.setdefault(bucket, []).append(tuple(item))
        ids, blobs = list(by), []
        for b in ids:
            raw = by[b]
            size = 4 + 20 * len(raw) + sum(len(x[0]) for x in raw) + len(raw) - 1
            blobs.append(size.to_bytes(4, "little") + _encode(raw))
        cols = np.array(settled, dtype=np.int64).reshape(-1, 4)
        for a in range(0, len(cols), SETTLED):
            place = mix(np.array([TaskContext.get().partitionId(), sent, a], dtype=_U)).sum(dtype=_U)
            ids.append(-1 - int(mix(np.array([place], dtype=_U))[0] % _U(buckets)))
            blobs.append(_encode_ranges(cols[a : a + SETTLED]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def scatter(it):
        ranks, sent = rank.value, 0
        best, again, settled, size = {}, set(), [], 0
        for b in it:
            ids = b.column(0).fill_null(_NULL).to_pylist()
            hs = b.column(1).to_pylist()
            for row, data, off in chunks(b.column(2)):
                s, e, first = words(data, off)
                at, n, low = super_kmers(word_hashes(data, s, e), first, ranks)
                if not len(at):
                    continue
                text, ps, pe = packed(data, s, e)
                doc = np.searchsorted(first, at, "right") - 1
                bucket = (mix(low) % _U(buckets)).astype(np.int64).tolist()
                own = (at - first[doc]).tolist()
                for x, y, d, k, o, w in zip(ps[at].tolist(), pe[at + n + WINDOW - 2].tolist(), doc.tolist(), bucket, own, n.tolist(), strict=True):
                    piece = text[x:y]
                    order, h = ids[row + d], hs[row + d]
                    was = best.get(piece)
                    if was is None:
                        best[piece] = (k, order, h, o, w)
                        size += y - x
                    elif order > was[1]:
                        settled.append((order, h, o, o + w + WINDOW - 1))
                    elif order < was[1]:
                        settled.append((was[1], was[2], was[3], was[3] + was[4] + WINDOW - 1))
                        best[piece] = (k, order, h, o, w)
                    elif (h, o) != was[2:4] and (item := (k, piece, order, h, o)) not in again:  # a repeated row says nothing new
                        again.add(item)
                        size += y - x
                if size > FLUSH or len(settled) > 500_000:
                    yield from flush(best, again, settled, sent)
                    best, again, settled, size, sent = {}, set(), [], 0, sent + 1
        yield from flush(best, again, settled, sent)

    return docs.mapInArrow(scatter, "bucket int, blob binary")


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, limit: int = 1 << 22) -> np.ndarray:
    """Whether the n bytes from a and from b are equal, for arrays of places; n is positive."""
    out = np.zeros(len(a), dtype=bool)
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(n) // limit)) + 1) if len(a) else []:
        size = n[part]
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        out[part] = np.logical_and.reduceat(data[np.repeat(a[part], size) + step] == data[np.repeat(b[part], size) + step], first)
    return out


def repeated(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(id order, row hash, first word, end word) of the runs of windows in one bucket that also start in a document with a smaller id."""
    ids, hs, starts, texts = zip(*map(_decode, blobs), strict=True)
    ids, hs, starts = (np.concatenate(x) for x in (ids, hs, starts))
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    off = np.concatenate(([0], np.flatnonzero(data == 10) + 1, [len(data)]))
    s, e, first = words(data, off)
    h = word_hashes(data, s, e)
    at, g = windows(h, first, WINDOW)
    kmer = np.searchsorted(first, at, "right") - 1
    order = ids[kmer]
    other = span(prefix(mix(h ^ _U(0x6A09E667F3BCC908)), WORDS), at, at + WINDOW, WORDS)
    o = np.lexsort((order, other, g))
    same = np.flatnonzero((g[o][1:] == g[o][:-1]) & (other[o][1:] == other[o][:-1]))
    x, y = s[at[o[same]]], s[at[o[same + 1]]]
    n = e[at[o[same]] + WINDOW - 1] - x
    like = n == e[at[o[same + 1]] + WINDOW - 1] - y
    same = same[like][same_bytes(data, x[like], y[like], n[like])]  # equal hashes are not taken on trust
    new = np.ones(len(o), dtype=bool)
    new[same + 1] = False
    head = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
    gone = np.zeros(len(o), dtype=bool)
    gone[o] = order[o] > order[o][head]
    hit = np.flatnonzero(gone)
    if not len(hit):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    cut = np.flatnonzero((np.diff(hit) != 1) | (kmer[hit][1:] != kmer[hit][:-1])) + 1
    a = hit[np.concatenate(([0], cut))]
    z = hit[np.concatenate((cut - 1, [len(hit) - 1]))]
    base = starts[kmer[a]] - first[kmer[a]]
    return order[a], hs[kmer[a]], at[a] + base, at[z] + base + WINDOW


def marked(docs: DataFrame, text_col: str = "t") -> DataFrame:
    """Word ranges (doc_id, h, s, e) to remove from a table (doc_id, h, t)."""
    import pandas as pd

    buckets = max(8 * parts(docs.sparkSession), SPREAD * docs.rdd.getNumPartitions())
    sent = scattered(docs, buckets, heavy_ranks(docs, text_col, buckets))

    def gather(pdf):
        blobs = pdf["blob"].tolist()
        if pdf["bucket"].iloc[0] < 0:
            d, h, s, e = (np.concatenate(x) for x in zip(*map(_decode_ranges, blobs), strict=True))
        else:
            d, h, s, e = repeated(blobs)
        return pd.DataFrame({"doc_id": d, "h": h, "s": s.astype(np.int32), "e": e.astype(np.int32)})

    return sent.groupBy("bucket").applyInPandas(gather, RANGES)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    Removed is each word covered by a window that also starts in a document with a smaller id.  A
    null id comes after every other; rows with one id do not remove each other's words.  Null
    and empty texts have no words.  Windows are judged on the input.  An empty table gives an
    empty result.  Other columns are not read, whatever their names.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(empty_to_string(text_col)).alias("h"), F.col(text_col).alias("t"))
    ranges = stored(marked(rows))
    # texts that lose nothing are finished where they are read; only the others travel to their ranges
    bits = spark.sparkContext.broadcast(np.full((1 << MEMBERS) // 8, 255, np.uint8) if texts else member_bits(ranges.select("h")))
    schema = "doc_id long, h long, t string, n_words long, kept_sha256 string"

    def split(it):
        for b in it:
            travel = is_member(bits.value, b.column(1).to_numpy())
            count, digest = [], []
            for row, data, off in chunks(b.column(2)):
                s, e, first = words(data, off)
                text, ps, pe = packed(data, s, e) if len(s) else (b"", s, e)
                for i, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    count.append(z - a)
                    digest.append(None if travel[row + i] else hashlib.sha256(text[ps[a] : pe[z - 1]] if z > a else b"").hexdigest())
            t = pc.if_else(pa.array(travel), b.column(2), pa.scalar(None, b.column(2).type))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), t, pa.array(count, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "h", "t", "n_words", "kept_sha256"])

    rows = rows.mapInArrow(split, schema)
    ranges = ranges.groupBy(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).agg(F.collect_set(F.struct("s", "e")).alias("ranges"))
    both = rows.join(ranges, (F.coalesce("doc_id", F.lit(_NULL)) == F.col("__d")) & (F.col("h") == F.col("__h")), "left").select("doc_id", "t", "ranges", "n_words", "kept_sha256")

    def finish(it):
        for b in it:
            spans, known, n = b.column(2), b.column(4), b.column(3).to_numpy()
            gone, digest, kept = [], [], []
            for row, data, off in chunks(b.column(1)):
                s, e, first = words(data, off)
                text, ps, pe = packed(data, s, e) if len(s) else (b"", s, e)
                for i in range(len(off) - 1):
                    if known[row + i].is_valid:
                        gone.append(0)
                        digest.append(known[row + i].as_py())
                        kept.append(None)
                        continue
                    a, z = int(first[i]), int(first[i + 1])
                    out, lost, cuts = b"", 0, spans[row + i].as_py()
                    if cuts:
                        m = np.zeros(z - a + 1, dtype=np.int32)
                        np.add.at(m, [c["s"] for c in cuts], 1)
                        np.add.at(m, [c["e"] for c in cuts], -1)
                        live = np.flatnonzero(np.cumsum(m)[: z - a] == 0)
                        lost = z - a - len(live)
                        out = b" ".join(text[x:y] for x, y in zip(ps[a + live].tolist(), pe[a + live].tolist(), strict=True))
                    elif z > a:
                        out = text[ps[a] : pe[z - 1]]
                    gone.append(lost)
                    digest.append(hashlib.sha256(out).hexdigest())
                    kept.append(out.decode("utf-8", "replace") if texts else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = both.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if texts else out.drop("kept_text")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deduplicated() over documents; null, empty and repeated rows as stated there."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM m, range(0, 13) s(j) WHERE least < doc_id),
word AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (
  SELECT word.doc_id, coalesce(string_agg(x, ' ' ORDER BY word.i) FILTER (WHERE gone.i IS NULL), '') AS t, count(gone.i) AS n
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
