"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled by a hash and queued, up to PASSES times over. A part of the queue has a virtual
finish time: the tokens of its source up to its end, divided by the source's target. All parts are range-sorted by it over
all sources, their tokens are summed up along that order, and the order is cut at the total budget; the part there is
taken in part. A part is a whole copy of a document, or a stretch of one that is longer than a PARTS-th of its source's
target: so a source ends within about that of its target, however long its documents are. Parts that start over two
PARTS-ths after time 1, at which all sources reach their targets, aren't queued.

No window spans a source: running_sums() adds up slices of the shuffle, so one source may hold most rows; the range sort
deals by time, which is even whatever the sources are."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlink.llm.common import SMALL_ROWS, WORD, checkpoint, group_key, running_sums, slice_bits

WEIGHTS, PASSES, SEED, PARTS = (5, 2, 1), 3, 17, 1024


class Cut(NamedTuple):
    """Where the order ends: the last part's finish time, source and place in its queue, and its words beyond the budget."""

    time: float
    g: str
    before: int
    beyond: int


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str, int], weights=WEIGHTS, share: float = 1.0, passes: int = PASSES) -> dict[str, float]:
    """The target of each source: `share` of all sizes by weight (repeating over the sources in order), none above
    `passes` times its size; the excess goes to the others by weight until none is above."""
    names = sorted(sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > passes * sizes[s]]
        if not full:
            out.update({s: left * weight[s] / total for s in open_})
            break
        for s in full:
            out[s] = float(passes * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
        left = max(0.0, left)
    return out


def _target_table(spark: SparkSession, sizes: dict[str, int], goal: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(s, sizes[s], goal[s]) for s in sizes] or [("", 0, 0.0)], "__k string, __source_size long, __target double")


def queued(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, passes: int = PASSES, seed: int = SEED) -> tuple[DataFrame, float]:
    """(doc_id, g, size, source_size, target, before): each row with its place in its source's queue; and the budget."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group_key(F.col("source")).alias("g"), words(F.col("text")).alias("size"))
    rows = checkpoint(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")))
    found = rows.groupBy("g").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()  # a row for each source
    sizes = {r.g: r.s for r in found}
    placed = running_sums(rows, "g", "h", "size", "before", slice_bits(sum(r.n for r in found)))
    goal = targets(sizes, weights, share, passes)
    table = _target_table(docs.sparkSession, sizes, goal)
    if len(sizes) <= SMALL_ROWS // 10:  # a row for each source; beyond, by shuffle
        table = F.broadcast(table)
    met = placed.join(table, F.col("g") == F.col("__k"))
    return checkpoint(met.select("doc_id", "g", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), "before")), math.fsum(goal.values())


def _timed(start: Column):
    return lambda x: F.struct((x["hi"] - x["lo"]).alias("words"), ((start + x["hi"]) / F.col("target")).alias("finish"))


def _parts(passes: int) -> Column:
    """All queued parts of a row: their words, and their finish time."""
    part = F.greatest(F.lit(1).cast("long"), F.floor(F.col("target") / PARTS).cast("long"))
    turns = []
    for turn in range(passes):
        start = F.col("source_size") * turn + F.col("before")
        room = F.least(F.col("size").cast("double"), F.col("target") * (1 + 2 / PARTS) - start)
        n = F.ceil(room / part).cast("int")

        ends = F.transform(F.sequence(F.lit(1).cast("long"), n.cast("long")), lambda k: F.struct(((k - 1) * part).alias("lo"), F.least(F.col("size"), k * part).alias("hi")))
        timed = F.transform(ends, _timed(start))
        turns.append(F.when((F.col("target") > 0) & (n > 0), timed).otherwise(F.array().cast("array<struct<words:bigint,finish:double>>")))
    return F.flatten(F.array(*turns))


def cut(q: DataFrame, budget: float, passes: int = PASSES) -> Cut:
    """Range-sorts the parts of a queue by finish time (ties to the earlier source) and finds where the budget ends. To the
    driver come a number for each range, and one row."""
    parts = q.select("g", "before", F.explode(_parts(passes)).alias("p")).select("g", "before", "p.words", "p.finish")
    order = parts.repartitionByRange("finish", "g").sortWithinPartitions("finish", "g")
    order = checkpoint(order.withColumn("range", F.spark_partition_id()))
    left = round(budget)
    for r in order.groupBy("range").agg(F.sum("words").alias("n")).orderBy("range").collect():
        if r.n >= left > 0:
            upto = F.sum("words").over(Window.partitionBy("range").orderBy("finish", "g").rowsBetween(Window.unboundedPreceding, 0))
            last = order.where(F.col("range") == r.range).withColumn("upto", upto).where(F.col("upto") >= left).orderBy("finish", "g").first()
            return Cut(last.finish, last.g, last.before, last.upto - left)
        left -= r.n
    return Cut(math.inf, "", -1, 0)


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target (both of its source), taken (words in the mix, with
    repeats), finish (virtual time at which its first copy ends).

    Null text has size 0 and is taken 0 times; a null source is a source of its own, last in order. Sources without words
    have target 0. Repeated rows are queued each for itself. The shuffle depends on doc_id and size alone, so reruns and
    other partitionings agree on every source's total and, ids being unique, on every row. An empty table gives no rows."""
    q, budget = queued(docs, weights, share, passes, seed)
    end = cut(q, budget, passes)
    inside = lambda p: (p["finish"] < end.time) | ((p["finish"] == end.time) & (F.col("g") <= end.g))
    taken = F.aggregate(_parts(passes), F.lit(0).cast("long"), lambda n, p: n + F.when(inside(p), p["words"]).otherwise(0))
    beyond = F.when((F.col("g") == end.g) & (F.col("before") == end.before) & (F.col("size") > 0), end.beyond).otherwise(0)
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("size")) / F.col("target"))
    return q.select("doc_id", "size", "source_size", "target", (taken - beyond).cast("long").alias("taken"), finish.alias("finish"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """The mix itself: whole copies of the rows of docs, with its columns and no others. A copy is in if its middle's time
    comes before the cut, so a source misses its target by about half a document at most. Rows without words stay once.
    Null texts have no words, a null source is one of its own, repeated rows are queued each for itself, and an empty
    table stays empty."""
    q, budget = queued(docs, weights, share, passes, seed)
    end = cut(q, budget, passes)
    copies = F.lit(0)
    for turn in range(passes):
        middle = (F.col("source_size") * turn + F.col("before") + F.col("size") / 2) / F.col("target")
        copies = copies + F.when((F.col("target") > 0) & (middle < end.time), 1).otherwise(0)
    copies = F.when(F.col("size") == 0, 1).otherwise(copies)
    # rows that share an id and a size are alike to the queue: their copies are dealt evenly
    plan = q.groupBy(F.col("doc_id").alias("__d"), F.col("g").alias("__g"), F.col("size").alias("__w")).agg(F.sum(copies).alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__src": group_key(F.col("source")), "__size": words(F.col("text"))})
    same = F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__src") == F.col("__g")) & (F.col("__size") == F.col("__w"))
    met = keyed.join(plan, same)
    times = F.floor((F.col("__copies") + F.col("__rows") / 2) / F.col("__rows")).cast("int")
    return met.withColumn("__copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).select(*docs.columns)
