"""Mixing sources to target weights by min-cost flow for overlapping sources.

Documents are aggregated by membership pattern (the set of sources they belong to) into token
capacities; only these sums reach the driver, one for each pattern, and not even these where sources do not
overlap and are very many: then targets and takings are a table.  A flow network routes
pattern capacity to source quotas: pattern -> source arcs, and in front of each pattern one arc
for each repetition, whose cost rises with the repetition (convex), so every token is used once
before any is used twice.  The flow fixes how many tokens of each pattern are taken; documents
are then chosen by a seeded hash: all get the whole repetitions, and those below a hash cut one
more.  The cut is found exactly from sums over hash buckets (partial aggregation) and an ordered
look at the one bucket in which it falls, so no source is ever sorted as a whole.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import empty_to_string, numbered, stored

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MAX_REPEAT = 2
SEED = 17
BUCKETS = 1024
#: Patterns whose sums may reach the driver.
MAX_PATTERNS = 100_000
#: Patterns whose plan is broadcast.
SMALL = 10_000


def word_count(text: str) -> Column:
    """Words of the text: each run of other characters than white space shrinks to one character."""
    t = empty_to_string(text)
    runs = F.regexp_replace(t, r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(runs, r"[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(sizes: dict, weights=WEIGHTS, share: Fraction = SHARE, most: int = MAX_REPEAT) -> dict:
    """Targets by source: share of all sizes by weight, none above `most` times its size, the excess reshared by weight.

    Sources stand in code-point order, null last; weights repeat in that order.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, rest = {}, list(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] > most * sizes[s] * total]
        if not over:
            return out | {s: rest * Fraction(weight[s], total) for s in open_}
        for s in over:
            out[s] = Fraction(most * sizes[s])
            rest -= out[s]
            open_.remove(s)
        rest = max(rest, Fraction(0))
    return out


class Network:
    """Arcs with capacities; maximum flows by levels and blocking flows."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def arc(self, a: int, b: int, room: int) -> int:
        """The number of a new arc; the next number is its reverse."""
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def augment(self, s: int, t: int) -> None:
        """Raises the flow until no path from s to t is left."""
        to, room, out = self.to, self.room, self.out
        while True:
            level = [-1] * len(out)
            level[s] = 0
            todo = deque([s])
            while todo and level[t] < 0:
                a = todo.popleft()
                for i in out[a]:
                    if room[i] and level[to[i]] < 0:
                        level[to[i]] = level[a] + 1
                        todo.append(to[i])
            if level[t] < 0:
                return
            at, path, a = [0] * len(out), [], s
            while True:
                if a == t:
                    push = min(room[i] for i in path)
                    for i in path:
                        room[i] -= push
                        room[i ^ 1] += push
                    cut = next(j for j, i in enumerate(path) if not room[i])
                    a = to[path[cut] ^ 1]
                    del path[cut:]
                while at[a] < len(out[a]) and not (room[out[a][at[a]]] and level[to[out[a][at[a]]]] == level[a] + 1):
                    at[a] += 1
                if at[a] < len(out[a]):
                    path.append(out[a][at[a]])
                    a = to[path[-1]]
                elif a == s:
                    break
                else:
                    a = to[path.pop() ^ 1]
                    at[a] += 1


def min_cost_flow(capacity: dict, quota: dict, most: int = MAX_REPEAT) -> dict:
    """{(pattern, source): tokens} of a maximum flow of least convex repetition cost.

    pattern is a tuple of sources.  Only arcs out of the start cost anything, more with each repetition, and no
    augmenting path gives back what has left the start.  So repetitions are opened one after the other, and
    a maximum flow after each is one of least cost.  Integer tokens.
    """
    patterns, sources = sorted(capacity, key=repr), sorted(quota, key=repr)
    at = {q: 2 + len(patterns) + j for j, q in enumerate(sources)}
    net = Network(2 + len(patterns) + len(sources))
    use, begin = {}, []
    for i, p in enumerate(patterns):
        begin.append(net.arc(0, 2 + i, 0))
        for q in sorted(set(p), key=repr):
            use[p, q] = net.arc(2 + i, at[q], most * capacity[p])
    for q in sources:
        net.arc(at[q], 1, quota[q])
    for _ in range(most):
        for i, p in zip(begin, patterns, strict=True):
            net.room[i] += capacity[p]
        net.augment(0, 1)
    return {k: net.room[i + 1] for k, i in use.items()}


def targets_table(sizes: DataFrame, weights=WEIGHTS, share: Fraction = SHARE, most: int = MAX_REPEAT) -> DataFrame:
    """source_targets() of a table (source, size) of any length: (source, size, target).

    A source is capped if its cap for each weight lies below the share for each weight of the others, so one
    number tells the capped ones; it rises until it stays.
    """
    spark = sizes.sparkSession
    ordered = sizes.orderBy(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ordered = stored(ordered)
    before, seen = [], 0
    for r in ordered.groupBy("part").agg(F.count("*").alias("c"), F.min("at").alias("first")).orderBy("part").collect():  # a row for each partition
        before.append((r["part"], seen - r["first"]))
        seen += r["c"]
    index = F.col("at") + F.col("add")
    weight = F.element_at(F.array(*map(F.lit, weights)), (index % len(weights) + 1).cast("int"))
    rows = ordered.join(F.broadcast(spark.createDataFrame(before, "part int, add long")), "part").withColumn("weight", weight)
    total = float(share) * float(ordered.agg(F.sum("size")).first()[0] or 0)
    level = -1.0
    while True:
        over = most * F.col("size") < F.lit(level) * F.col("weight")
        open_, capped = rows.agg(F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, most * F.col("size")))).first()
        new = max(0.0, total - float(capped or 0)) / open_ if open_ else level
        if new <= level or not open_:
            break
        level = new
    return rows.select("source", "size", F.least(F.lit(float(most)) * F.col("size"), F.lit(level) * F.col("weight")).alias("target"))


PLAN = "pattern array<string>, whole int, rest long, source_size long, target double"


def planned(spark: SparkSession, capacity: dict) -> list[tuple]:
    """Rows of PLAN for the tokens of each pattern."""
    sizes: dict = {}
    for p, n in capacity.items():
        for q in p:
            sizes[q] = sizes.get(q, 0) + n
    targets = source_targets(sizes)
    if any(len(p) > 1 for p in capacity):  # overlapping sources share tokens: the whole must stay within what there is
        flow = min_cost_flow(capacity, {q: int(v) for q, v in targets.items()})
    else:
        flow = min_cost_flow(capacity, {q: round(v) for q, v in targets.items()})
    plan = []
    for p, n in capacity.items():
        taken = sum(flow[p, q] for q in set(p))
        whole = min(taken // n, MAX_REPEAT) if n else 0
        plan.append((list(p), whole, taken - whole * n, sizes[p[0]], float(targets[p[0]])))
    return plan


def _pattern(docs: DataFrame, source_col: str) -> Column:
    many = isinstance(docs.schema[source_col].dataType, T.ArrayType)
    src = F.col(source_col) if many else F.array(F.col(source_col).cast("string"))
    return F.when(F.coalesce(F.size(src), F.lit(0)) > 0, F.array_sort(F.array_distinct(src))).otherwise(F.array(F.lit(None).cast("string")))


def _key(id_col: str, text_col: str, pattern: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(empty_to_string(text_col)), F.array_join(pattern, "\0", "\1"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, copies (taken = copies * size).

    source_col is a string, or an array of strings where sources overlap; a null or empty array
    belongs to the null source.  For overlapping sources source_size and target are those of the
    pattern's first source.  Null text has size 0; rows equal in id, text and sources are numbered and taken
    each by its own hash; an empty table gives an empty result.  Other columns are not read.  Overlapping
    sources of more than MAX_PATTERNS patterns raise an error, as the flow is solved on the driver.
    """
    spark = docs.sparkSession
    pattern = _pattern(docs, source_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), pattern.alias("pattern"), _key(id_col, text_col, pattern, seed).alias("key"), word_count(text_col).alias("size"))
    rows = stored(rows)
    if rows.groupBy("key").count().where("count > 1").take(1):
        rows = numbered(rows, ["key"], "n").withColumn("h", F.when(F.col("n") > 0, F.xxhash64("key", "n")).otherwise(F.col("key"))).drop("n")
    else:
        rows = rows.withColumn("h", F.col("key"))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(BUCKETS))).withColumn("order", F.shiftrightunsigned("h", 1))
    rows = stored(rows)
    sums = stored(rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("size")))
    whole = sums.groupBy("pattern").agg(F.sum("size").alias("size"))
    found = whole.limit(MAX_PATTERNS + 1).collect()
    small = len(found) <= SMALL
    if len(found) <= MAX_PATTERNS:
        plan = spark.createDataFrame(planned(spark, {tuple(r["pattern"]): int(r["size"]) for r in found}), PLAN)
    elif whole.where(F.size("pattern") > 1).take(1):
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns of overlapping sources")
    else:
        targets = targets_table(whole.select(F.get("pattern", F.lit(0)).alias("source"), "size"))
        taken = F.least(F.bround("target").cast("long"), F.lit(MAX_REPEAT) * F.col("size"))
        times = F.when(F.col("size") > 0, F.least(F.floor(taken / F.col("size")), F.lit(MAX_REPEAT))).otherwise(0).cast("int")
        plan = targets.select(F.array("source").alias("pattern"), times.alias("whole"), (taken - times * F.col("size")).alias("rest"), F.col("size").alias("source_size"), "target")
    light = F.broadcast if small else lambda x: x
    # array equality is null-safe for the elements, so the null source joins as well
    before = F.coalesce(F.sum("size").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (sums.withColumn("before", before).join(light(plan.select("pattern", "rest")), "pattern")
           .where("before <= rest AND rest < before + size").select("pattern", "bucket", (F.col("rest") - F.col("before")).alias("left")))
    cut = stored(cut)
    inside = rows.join(light(cut), ["pattern", "bucket"]).withColumn(
        "upto", F.sum("size").over(Window.partitionBy("pattern", "bucket").orderBy("order")))
    # half a document more or less: the last one goes in if at least half of it fits
    inside = inside.where(F.col("upto") - F.col("size") / 2 <= F.col("left")).groupBy("pattern").agg(F.max("order").alias("top"))
    cut = cut.join(inside, "pattern", "left").select("pattern", F.col("bucket").alias("cut"), F.coalesce("top", F.lit(-1)).alias("top"))
    plan = light(plan.join(cut, "pattern", "left"))
    more = F.coalesce((F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & (F.col("order") <= F.col("top"))), F.lit(False))
    copies = F.least(F.lit(MAX_REPEAT), F.col("whole") + F.when(more, 1).otherwise(0))
    out = rows.join(plan, "pattern").withColumn("copies", copies)
    return out.select("doc_id", "key", F.get(F.col("pattern"), F.lit(0)).alias("source"), "size", "source_size", "target",
                      (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def resampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: every input row as often as it is taken, all columns as they came.

    Null and empty texts have no words and are taken as their source's cut falls; of rows equal in id,
    text and sources as many come out as the mix takes of them together.
    """
    key = _key(id_col, text_col, _pattern(docs, source_col), seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    plan = stored(mixed(docs, id_col, text_col, source_col, seed).groupBy("key").agg(F.sum("copies").alias("all"), F.count("*").alias("rows")))
    if plan.where("rows > 1").take(1):
        rows = numbered(rows, ["key"], "i")
    else:
        rows = rows.withColumn("i", F.lit(0))
    # the copies of equal rows, dealt out evenly
    joined = rows.join(plan.where("all > 0"), "key").withColumn("n", F.floor(F.col("all") / F.col("rows")) + F.when(F.col("i") < F.col("all") % F.col("rows"), 1).otherwise(0))
    return joined.where("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mixed() over documents; null, empty and repeated rows as stated there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).select("doc_id", "source", "size", "source_size", "target", "taken")
