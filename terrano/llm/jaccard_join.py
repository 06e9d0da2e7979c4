"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is the set of its distinct word n-grams (64-bit hashes).  All n-grams and words of all
documents are counted into fixed-size sketches; whether an n-gram stands out, then how frequent its
words are, then its hash give one global order, the rarest first (any total order is exact, rarity
only keeps the posting lists short).  Two sets
with Jaccard >= t share an n-gram within their first n - ceil(t n) + 1.  Only prefix n-grams
are joined; a pair must pass the length filter, the positional filter, and the suffix filter (a
lower bound of the Hamming distance from how both sets fall into the parts of a recursive
halving of the n-gram space: by parities in the join itself, then by counts) before its sets are fetched and it is verified, once.

The result is the components of the links, not all links, so groups of near copies need not be
expanded: equal sets are one class from the start (two 64-bit keys agree); then rounds join the
classes of a posting list with one leader of the list (the class that shares most of its prefix,
usually the text that the others were made from), and merge what links.  At last every remaining
pair of classes that share a prefix n-gram and lie in different components is verified, so no link
that would join two components is lost; a run of consecutive shared n-grams, as a common passage
makes, gives the pair once, at its first.  Rounds repeat while they merge and the remaining pairs are many.

Sketches cannot tell how rare an n-gram is once the input outgrows them, and a passage that many
unlike texts share would pair all of them.  So where the pairs would outnumber the postings by far, the
posting lists themselves, which are exact, correct the order before the last round: n-grams whose list
joins CROWD components or more go to the end of it, and the prefixes of all classes that hold one are
taken anew.  This changes the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLOCK_SCHEMA, emit_blocks, forget, freed, is_member, member_bits, prepare, stored, sum_blocks, text_hash, without
from .components import components
from .textvec import chunks, mix, shingle_sets, windows, word_hashes, words
from .textvec import LOWER as LOW

#: log2 of the counters of the rarity sketches: n-grams (16 MB) and words (4 MB).
SKETCH, WORD_SKETCH = 22, 20
#: Parts of the n-gram space for the suffix filter: counted, and by parity (64 in each long).
PARTS = 128
LONGS = 8
PARITY = [f"q{i}" for i in range(LONGS)]
#: The n-grams before one in the postings of its class.
BEFORE = [f"v{i}" for i in range(4)]
MAX_ROUNDS = 6
#: Components in a posting list from which its n-gram may go to the end of the order, how often that is
#: done at most, and how many pairs there must be for each posting to make it worth while.
CROWD, REORDERS, WORTH = 12, 2, 16
_U = np.uint64


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def set_key(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Twice 64 bits that stand for a set, each from a sum of its own mixes of the hashes; fewer bits in the first for tests."""
    sums = np.array([mix(s).sum(dtype=_U), mix(s ^ _U(0x6A09E667F3BCC908)).sum(dtype=_U)])
    key, chk = mix(sums + np.array([len(s)], dtype=_U) * _U(0x9E3779B97F4A7C15)).view(np.int64).tolist()
    return key >> (64 - bits), chk


def _batches(it, step: int = 200) -> Iterator[pa.RecordBatch]:
    for b in it:
        for a in range(0, b.num_rows, step):
            yield b.slice(a, step)


def rarity(docs: DataFrame, text_col: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two tables over all documents, by leading bits of hashes: log2 of how far n-grams stand out, and log2 counts of words.

    The first finds n-grams that many documents share; below its noise, n-grams of rare words come first.
    """
    def count(it):
        from pyspark import TaskContext

        total = np.zeros((1 << SKETCH) + (1 << WORD_SKETCH), dtype=np.uint32)
        grams, single = total[: 1 << SKETCH], total[1 << SKETCH :]
        for b in it:
            for _, data, off in chunks(b.column(0)):
                low = LOW[data]
                s, e, first = words(low, off)
                h = word_hashes(low, s, e)
                np.add.at(single, (h >> _U(64 - WORD_SKETCH)).astype(np.int64), 1)
                np.add.at(grams, (windows(h, first, k)[1] >> _U(64 - SKETCH)).astype(np.int64), 1)
        yield from emit_blocks(total, TaskContext.get().partitionId())

    n = docs.rdd.getNumPartitions()
    total = sum_blocks(docs.sparkSession, docs.select(text_col).mapInArrow(count, BLOCK_SCHEMA), (1 << SKETCH) + (1 << WORD_SKETCH), n)
    grams, single = total[: 1 << SKETCH], total[1 << SKETCH :]
    # counters near the mean hold many rare n-grams each: they are alike, and only what stands out is ordered
    return np.log2(np.maximum(grams / (2 * grams.mean() + 1), 1)).astype(np.uint8), (4 * np.log2(1.0 + single)).astype(np.uint8)


def parts_of(n: int) -> int:
    """Counted parts of a set's signature: a power of two, about one for eight n-grams, so that long sets are told apart as well."""
    return max(PARTS, 1 << (n // 8).bit_length())


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the Hamming distance from two signatures; the longer one is folded to the shorter one's parts."""
    x, y = (np.frombuffer(v, dtype=np.uint8).astype(np.int64) for v in (x, y))
    k = min(len(x), len(y))
    x, y = ((v.reshape(-1, k).sum(0) if len(v) > k else v) for v in (x, y))
    return int(np.abs(x - y).sum())


SCHEMA = "doc_id long, h long, n int, key long, chk long, sig binary, parity array<long>, tokens array<long>"


def prefix_of(s: np.ndarray, w: np.ndarray, rank: np.ndarray, late: np.ndarray | None, t: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 n-grams of a set in the global order: late ones last, then by sketch, word weight and hash."""
    order = rank[(s >> _U(64 - SKETCH)).astype(np.int64)] * np.int64(1 << 20) + w
    if late is not None:
        order = order + is_member(late, s) * np.int64(1 << 40)
    n = len(s)
    return s[np.argsort(order, kind="stable")[: n - -(-t * n // 100) + 1]]


def described(docs: DataFrame, id_col: str, text_col: str, k: int, t: int, rare, key_bits: int) -> DataFrame:
    """One row per input row: id, text hash, set size, class keys, and for the first row of a class in its task the prefix and the suffix-filter parts."""
    def describe(it):
        (rank, weight), seen = rare.value, set()
        for b in _batches(it):
            ns, keys, sigs, odd, heads = [], [], [], [], []
            for _, s, w in shingle_sets(b.column(2), k, weight):
                n = len(s)
                key = set_key(s, key_bits) if n else (None, None)
                ns.append(n)
                keys.append(key)
                if not n or key in seen:
                    sigs.append(None)
                    odd.append(None)
                    heads.append(None)
                    continue
                seen.add(key)
                heads.append(prefix_of(s, w, rank, None, t).view(np.int64))
                # other bits than the sketch's, as the parts must split what is alike there
                many = parts_of(n)
                part = np.bincount(((s >> _U(8)) & _U(many - 1)).astype(np.int64), minlength=many)
                sigs.append(np.minimum(part, 255).astype(np.uint8).tobytes())
                part = np.bincount(((s >> _U(20)) & _U(64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS) & 1
                odd.append(np.packbits(part.astype(bool)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1), pa.array(ns, pa.int32()), *[pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)],
                 pa.array(sigs, pa.binary()), pa.array(odd, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int64()))],
                names=["doc_id", "h", "n", "key", "chk", "sig", "parity", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("h"), F.col(text_col)).mapInArrow(describe, SCHEMA)


def named(df: DataFrame, clash: DataFrame | None) -> DataFrame:
    """Class keys (key, chk) as one class number: the key, or another where unlike sets share a key."""
    if clash is None:
        return df.withColumnRenamed("key", "cls").drop("chk")
    return df.join(clash, ["key", "chk"], "left").withColumn("cls", F.coalesce("other", "key")).drop("key", "chk", "other")


def clashes(rows: DataFrame) -> DataFrame | None:
    """(key, chk, other): a new number for each class whose key another class has as well; usually there is none."""
    many = rows.where("n > 0").groupBy("key").agg(F.min("chk").alias("lo"), F.max("chk").alias("hi")).where("lo != hi").select("key")
    if not many.take(1):
        return None
    return stored(rows.join(many, "key").select("key", "chk").distinct().withColumn("other", F.xxhash64("chk", "key")))


def _overlap(na, nb, t: int):
    """The least intersection of two sets of these sizes that link: 100 i >= t (na + nb - i)."""
    return F.ceil(F.lit(t) * (na + nb) / F.lit(100.0 + t) - F.lit(1e-9))


def _passes(t: int, qa: list, qb: list):
    """Length, positional and parity filter for two postings of one n-gram.

    Where the sizes of a part differ in parity, the sets differ there by one n-gram at least.
    """
    na, nb, pa_, pb = F.col("na"), F.col("nb"), F.col("pa"), F.col("pb")
    bound = F.least(pa_, pb) + 1 + F.least(na - pa_ - 1, nb - pb - 1)
    apart = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(qa, qb, strict=True)), F.lit(0))
    need = _overlap(na, nb, t)
    return (100 * F.least(na, nb) >= t * F.greatest(na, nb)) & (bound >= need) & (apart <= na + nb - 2 * need)


def suffix_filtered(pairs: DataFrame, sigs: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose Hamming lower bound leaves room for a link."""
    def side(c):
        return sigs.select(F.col("cls").alias(c), F.col("sig").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def check(it):
        for b in it:
            if not b.num_rows:
                continue
            na, nb = (b.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            need = -(-t * (na + nb) // (100 + t))
            lower = np.array([apart(x, y) for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True)])
            ok = lower <= na + nb - 2 * need
            yield b.select(["a", "b", "na", "nb"]).filter(pa.array(ok))

    return both.mapInArrow(check, "a long, b long, na int, nb int")


class Texts:
    """The documents and what describes their classes, to come back to the texts of some of them."""

    def __init__(self, docs: DataFrame, text_col: str, k: int, t: int, rare, sigs: DataFrame, clash: DataFrame | None, key_bits: int):
        self.rows = docs.select(F.col(text_col).alias("text"), text_hash(text_col).alias("h"))
        self.k, self.t, self.rare, self.sigs, self.clash, self.key_bits = k, t, rare, sigs, clash, key_bits

    def of(self, classes: DataFrame):
        """A reader of Arrow batches (text, h) that yields batches of one document at least of each class
        in a table (cls), found by hash, and of some others."""
        h = self.sigs.join(classes, "cls", "left_semi").select("h")
        bits = classes.sparkSession.sparkContext.broadcast(member_bits(h))

        def read(it) -> Iterator[pa.RecordBatch]:
            for b in _batches(it):
                yield b.filter(pa.array(is_member(bits.value, b.column(1).to_numpy())))

        return read

    def sets(self, classes: DataFrame) -> DataFrame:
        """(cls, set) of the classes, once for each task that reads one; some others as well."""
        k, key_bits, read = self.k, self.key_bits, self.of(classes)

        def fetch(it):
            seen = set()
            for b in read(it):
                keys, sets = [], []
                for _, s in shingle_sets(b.column(0), k):
                    key = set_key(s, key_bits) if len(s) else None
                    if key and key not in seen:
                        seen.add(key)
                        keys.append(key)
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([*[pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)], pa.array(sets, pa.binary())], names=["key", "chk", "set"])

        return named(self.rows.mapInArrow(fetch, "key long, chk long, set binary"), self.clash)

    def prefixes(self, classes: DataFrame, late) -> DataFrame:
        """(cls, n, tokens) of the classes under an order with late n-grams at its end; some others as well."""
        k, t, rare, key_bits, read = self.k, self.t, self.rare, self.key_bits, self.of(classes)

        def describe(it):
            (rank, weight), seen = rare.value, set()
            for b in read(it):
                keys, ns, heads = [], [], []
                for _, s, w in shingle_sets(b.column(0), k, weight):
                    key = set_key(s, key_bits) if len(s) else None
                    if key and key not in seen:
                        seen.add(key)
                        keys.append(key)
                        ns.append(len(s))
                        heads.append(prefix_of(s, w, rank, late.value, t).view(np.int64))
                yield pa.RecordBatch.from_arrays([*[pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)], pa.array(ns, pa.int32()), pa.array(heads, pa.list_(pa.int64()))], names=["key", "chk", "n", "tokens"])

        found = named(self.rows.mapInArrow(describe, "key long, chk long, n int, tokens array<long>"), self.clash)
        return found.join(classes, "cls", "left_semi").select("cls", "n", "tokens")


def verified(pairs: DataFrame, texts: Texts) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets; written."""
    t = texts.t
    nodes = stored(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())
    sets = stored(texts.sets(nodes).join(nodes, "cls", "left_semi"))

    def side(c):
        return sets.select(F.col("cls").alias(c), F.col("set").alias(f"s{c}"))

    def check(it):
        for b in _batches(it, 100):
            ok, was, x = [], None, None
            for a, p, q in zip(b.column("a").to_pylist(), b.column("sa"), b.column("sb"), strict=True):
                if a != was:
                    was, x = a, np.frombuffer(p.as_buffer(), dtype=_U)
                y = np.frombuffer(q.as_buffer(), dtype=_U)
                i = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * i >= t * (len(x) + len(y) - i))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb")
    out = stored(both.mapInArrow(check, "a long, b long").distinct())
    forget(pairs.sparkSession, nodes, sets)
    return out


def postings(heads: DataFrame, odd: DataFrame, t: int) -> DataFrame:
    """The postings of a table (cls, n, tokens) whose n-gram another class has in its prefix as well; written.

    Which n-grams these are comes from an aggregation, so a frequent one is a row a task, and the join
    that follows can be split.
    """
    p = heads.select("cls", "n", F.posexplode("tokens").alias("pos", "token"))
    shared = p.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select("token")
    p = first = stored(p.join(shared, "token").select("token", "cls", "n", "pos").distinct())
    freed(heads.sparkSession)
    own = Window.partitionBy("cls")
    p = p.withColumn("share", F.count("*").over(own) / (F.col("n") * (100 - t) / 100 + 1))
    for i, v in enumerate(BEFORE):
        p = p.withColumn(v, F.lag("token", i + 1).over(own.orderBy("pos")))
    p = p.join(odd, "cls")
    p = stored(p.select("token", "cls", "n", "pos", *BEFORE, "share", *[F.get("parity", F.lit(i)).alias(q) for i, q in enumerate(PARITY)]))
    forget(heads.sparkSession, first)
    return p


def with_lists(p: DataFrame, members: DataFrame | None) -> DataFrame:
    """Postings of lists that join several components, with their component and all, major, comps of the list; written."""
    now = p if members is None else p.join(members.select(F.col("node").alias("cls"), "root"), "cls", "left")
    now = now.withColumn("comp", F.col("cls") if members is None else F.coalesce("root", "cls")).drop("root")
    per = now.groupBy("token", "comp").agg(F.count("*").alias("c"))
    lists = per.groupBy("token").agg(F.sum("c").alias("all"), F.max_by("comp", F.struct("c", "comp")).alias("major"), F.count("*").alias("comps")).where("comps > 1")
    out = stored(now.join(lists, "token"))
    del now, per, lists
    freed(p.sparkSession)
    return out


def leader_pairs(now: DataFrame, round_: int) -> DataFrame:
    """Each posting with the leader of its list: from the main component once there is one, by the share
    of its prefix that others have, then by a hash that changes with the round."""
    rank = F.struct(F.col("comp") == F.col("major") if round_ > 1 else F.lit(True), F.col("share") if round_ == 0 else F.lit(0.0), F.xxhash64("cls", F.lit(round_)))
    lead = now.groupBy("token").agg(F.max_by(F.struct("cls", "n", "pos", "comp", *PARITY), rank).alias("lead"))
    return now.join(lead, "token").where("comp != lead.comp").select(
        F.col("lead.cls").alias("a"), F.col("cls").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb"), F.col("lead.pos").alias("pa"), F.col("pos").alias("pb"), *[F.col(f"lead.{q}").alias(f"x{q}") for q in PARITY], *PARITY)


def all_pairs(now: DataFrame) -> DataFrame:
    """Every pair of a list from different components: rows outside the list's main component meet the
    whole list; where a list shortly before this one holds both, the pair was made there or before."""
    names = {"cls": "x", "n": "nx", "pos": "px", "comp": "cx"} | {c: f"x{c}" for c in (*BEFORE, *PARITY)}
    minor = now.where("comp != major").select("token", *[F.col(c).alias(x) for c, x in names.items()])
    made = F.coalesce(reduce(lambda a, b: a | b, [F.col(f"x{v}").eqNullSafe(F.col(w)) & F.col(w).isNotNull() for v in BEFORE for w in BEFORE]), F.lit(False))
    first = F.col("x") < F.col("cls")
    both = minor.join(now, "token").where("comp != cx AND (comp = major OR x < cls)").where(~made)
    return both.select(
        F.least("x", "cls").alias("a"), F.greatest("x", "cls").alias("b"),
        F.when(first, F.col("nx")).otherwise(F.col("n")).alias("na"), F.when(first, F.col("n")).otherwise(F.col("nx")).alias("nb"),
        F.when(first, F.col("px")).otherwise(F.col("pos")).alias("pa"), F.when(first, F.col("pos")).otherwise(F.col("px")).alias("pb"), *[f"x{q}" for q in PARITY], *PARITY)


def crowded(now: DataFrame, heads: DataFrame, was: np.ndarray | None) -> tuple[np.ndarray, DataFrame] | None:
    """(bits of the n-grams that go to the end of the order, classes whose prefix holds one), or None if no list is crowded."""
    tokens = now.where(F.col("comps") >= CROWD).select("token").distinct()
    if not tokens.take(1):
        return None
    bits = member_bits(tokens)
    sent = now.sparkSession.sparkContext.broadcast(bits)

    def hit(it):
        for b in it:
            tokens = b.column(1)
            at = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(tokens.offsets)))
            keep = np.unique(at[is_member(sent.value, tokens.flatten().to_numpy())])
            yield b.select(["cls"]).take(pa.array(keep))

    # the bits decide, not the list they stand for: what they let through by chance is moved everywhere alike
    classes = stored(heads.select("cls", "tokens").mapInArrow(hit, "cls long").distinct())
    return (bits if was is None else bits | was), classes


def linked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, t: int = 80, key_bits: int = 64) -> DataFrame:
    """linked() with the hash h of each row's text and the number comp of its component; a written table."""
    spark = prepare(docs.sparkSession)
    freed(spark)
    rare = spark.sparkContext.broadcast(rarity(docs, text_col, k))
    described_rows = stored(described(docs, id_col, text_col, k, t, rare, key_bits))
    clash = clashes(described_rows)
    rows = named(described_rows, clash)
    whole = rows.where("tokens IS NOT NULL")
    heads, odd = whole.select("cls", "n", "tokens"), whole.groupBy("cls").agg(F.first("parity").alias("parity"))
    p = postings(heads, odd, t)
    sigs = stored(whole.groupBy("cls").agg(F.first("sig").alias("sig"), F.min("h").alias("h")))
    texts = Texts(docs, text_col, k, t, rare, sigs, clash, key_bits)
    members = None  # (node, root): classes in a component of several
    links: list[DataFrame] = []
    redone: list[DataFrame] = []
    late, reorders = None, 0
    left = round_ = 0
    while True:
        now = with_lists(p, members)
        total = now.agg(F.count("*"), F.sum(F.when(F.col("comp") != F.col("major"), F.col("all")).otherwise(0))).first()
        if not total[0]:
            forget(spark, now)
            break
        left, before = total[1] or 0, left
        # rounds with leaders are worth it while they merge; what they leave are lists of unlike texts
        last = round_ >= MAX_ROUNDS or (round_ > 0 and (left <= 16 * total[0] + 100_000 or 2 * left > before))
        if last and reorders < REORDERS and left > WORTH * total[0] and (new := crowded(now, heads, late)):
            late, classes = new
            reorders += 1
            fresh = stored(texts.prefixes(classes, spark.sparkContext.broadcast(late)))
            heads = heads.join(classes, "cls", "left_anti").unionByName(fresh)
            redone += [classes, fresh]
            forget(spark, now, p)
            p = postings(heads, odd, t)
            freed(spark)
            left = 0
            continue
        pairs = all_pairs(now) if last else leader_pairs(now, round_)
        pairs = pairs.where(_passes(t, [F.col(f"x{q}") for q in PARITY], [F.col(q) for q in PARITY])).groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))
        pairs = stored(suffix_filtered(pairs, sigs, t))
        found = verified(pairs, texts) if pairs.take(1) else None
        forget(spark, now, pairs)
        if found is not None and found.take(1):
            links.append(found)
            every = links[0]
            for x in links[1:]:
                every = every.unionByName(x)
            if members is not None:
                forget(spark, members)
            members = stored(components(every))
        freed(spark)
        round_ += 1
        if last:
            break
    least = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    if members is not None:
        roots = least.join(members.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("root", "cls"))
        roots = roots.select("cls", "comp").join(roots.groupBy("comp").agg(F.min("least").alias("least")), "comp")
    else:
        roots = least.withColumn("comp", F.col("cls"))
    out = rows.select("doc_id", "h", "n", "cls").join(roots, "cls", "left")
    out = stored(out.select("doc_id", "h", "comp", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")))
    forget(spark, described_rows, p, sigs, *links, *redone, *[x for x in (clash, members) if x is not None])
    freed(spark)
    return out


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, t: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest non-null id reachable by links).

    Two documents link when 100 * intersection >= t * union of their sets of k-grams (A-Z lower-cased;
    a text of fewer words is one k-gram).  Null and empty texts have empty sets and link with
    nothing.  Repeated rows link with each other as equal sets do.  A null id never names a
    component that holds another.  An empty table gives an empty result.  Other columns are not
    read, whatever their names.  k-grams are compared as 64-bit hashes.
    """
    return linked_rows(docs, id_col, text_col, k, t).drop("h", "comp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, t: int = 80) -> DataFrame:
    """One row of each component, all columns as they came: that of the smallest id, then of the smallest text hash.

    Of rows equal in id and text one stays; texts without a k-gram all stay, but for such repeats.
    Null ids come last.  An empty table gives an empty result.  Rows that are sure to stay do not
    move: only those whose key is among the dropped ones (a fixed-size filter tells) are joined.
    """
    rows = linked_rows(docs, id_col, text_col, k, t)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    best = rows.where("n_shingles > 0").groupBy("comp").agg(F.min(rank).alias("best")).select("comp", F.col("best.doc_id").alias("bd"), F.col("best.h").alias("bh"))
    gone = stored(rows.where("n_shingles > 0").join(best, "comp").where("NOT (doc_id <=> bd AND h = bh)").select("doc_id", "h").distinct())
    repeats = stored(rows.groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h"))
    forget(docs.sparkSession, rows)
    return without(docs, id_col, text_col, gone, repeats)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """linked() over documents: three words, Jaccard 0.9; null, empty and repeated rows as stated there."""
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, t=90)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, list_sort(list(g)) AS g FROM s GROUP BY doc_id),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY g) AS c FROM sets),
r AS (SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id) JOIN class USING (doc_id) WHERE class.c = class.doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a AS u, b AS v FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT doc_id, c FROM class UNION ALL SELECT c, doc_id FROM class),
reach(u, v) AS (SELECT doc_id, doc_id FROM class UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
root AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, documents.doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)
"""
