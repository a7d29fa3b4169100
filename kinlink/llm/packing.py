"""Packing documents into sequences of WINDOW tokens, mixed within each window, by deficit round robin.

Each source has a queue of its documents' tokens and a target weight; by default its part of all tokens, so that all
queues end together. A window's round adds the quantum WINDOW * weight / (all weights) to each queue's deficit, and serves,
token by token, the queue whose deficit, less half a token, is worth most of its weight (ties to the earlier source). What
is left of a deficit, or overdrawn, goes on to the next window. When a queue ends, a new phase begins: the weights of the
others share the windows. Served in that order, token j of a phase comes by (2j + 1) / weight, so the queues' state after
any number of tokens has a closed form (Queues.served()), a deficit stays below the number of sources, and a partition
can begin at any window with the deficits that all windows before it leave. No pass over the windows, and no shuffle of
tokens, is needed:

1. Texts are encoded once, into a table in the shared folder, with their place in their partition's part of each queue.
2. Sums per partition and source (one number each) are added up along the partitions, in Spark.
3. Each partition cuts its documents at the windows' borders. The rest of the last window is cut into powers of two,
   which need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm.common import group_key, slices, small, small_batches, written
from kinlink.llm.tokens import code_of, default_path, packed_ids

WINDOW, END = 4096, 2
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Share:
    """A fraction, compared exactly."""

    __slots__ = ("a", "b")

    def __init__(self, a: int, b: int):
        self.a, self.b = a, b

    def __lt__(self, other):
        return self.a * other.b < other.a * self.b

    def __eq__(self, other):
        return self.a * other.b == other.a * self.b


class Queues:
    """The order in which queues of given lengths are served by given whole weights (their lengths, if none are given).
    Queues of weight 0 come when all others have ended."""

    def __init__(self, totals: tuple[int, ...], weights: tuple[int, ...] | None = None):
        self.totals, self.whole = totals, sum(totals)
        self.starts, self.phases = [], []  # of each phase: its first token; what was served before, weights, how many it serves
        base, at = [0] * len(totals), 0
        while at < self.whole:
            left = [t - b for t, b in zip(totals, base)]
            by = [w if n else 0 for w, n in zip(weights or totals, left)]
            if not any(by):
                by = left
            first = min((_Share(n, w) for n, w in zip(left, by) if w))  # the queue that ends the phase, by rounds it lasts
            count = [(2 * first.a * w + first.b - 1) // (2 * first.b) for w in by]
            self.starts.append(at)
            self.phases.append((tuple(base), tuple(by), tuple(count)))
            base, at = [b + c for b, c in zip(base, count)], at + sum(count)

    def served(self, tokens: int) -> tuple[int, ...]:
        """How many tokens each queue has given when `tokens` are served; they add up to it."""
        if tokens >= self.whole:
            return self.totals
        k = bisect_right(self.starts, tokens) - 1
        base, by, most = self.phases[k]
        tokens -= self.starts[k]
        whole, n = sum(by), len(by)
        far = max(0, tokens - n)  # below this time at most `tokens` are served: each rounding adds at most a half
        count = [min(c, (2 * far * w + whole) // (2 * whole)) for w, c in zip(by, most)]
        # fractions (2 c + 1) / w are compared exactly
        heap = [(_Share(2 * c + 1, w), i) for i, (c, w) in enumerate(zip(count, by)) if c < most[i]]
        heapq.heapify(heap)
        for _ in range(tokens - sum(count)):
            _, i = heapq.heappop(heap)
            count[i] += 1
            if count[i] < most[i]:
                heapq.heappush(heap, (_Share(2 * count[i] + 1, by[i]), i))
        return tuple(b + c for b, c in zip(base, count))

    def rank(self, source: int, j: int) -> int:
        """The place of token j of a source among all tokens."""
        k = next(k for k, (base, _, count) in enumerate(self.phases) if base[source] <= j < base[source] + count[source])
        base, by, _ = self.phases[k]
        j -= base[source]
        mine, out = by[source], self.starts[k]
        for i, w in enumerate(by):
            x = (2 * j + 1) * w - mine  # how many j' have (2 j' + 1) / w below, or for an earlier source at, (2 j + 1) / mine
            out += j if i == source else max(0, x // (2 * mine) + 1 if i < source else -(-x // (2 * mine))) if w else 0
        return out


def cut_last(rest: int, window: int) -> list[int]:
    """The last window's tokens as lengths of sequences: powers of two, the largest first."""
    return [window] if rest == window else [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Schedule:
    """The windows of given queues: what each queue has given before and after one, and where its part begins."""

    def __init__(self, queues: Queues, window: int = WINDOW):
        self.queues, self.window, self.whole = queues, window, queues.whole
        self.last = (self.whole - 1) // window
        self.known: dict[int, tuple] = {}

    def of(self, w: int) -> tuple:
        found = self.known.get(w)
        if found is None:
            if len(self.known) >= 50_000:
                self.known.clear()
            last = self.known.get(w - 1)  # carried on from the window before, where this partition has seen it
            before = last[1] if last else self.queues.served(w * self.window)
            after = self.queues.served((w + 1) * self.window)
            starts, at = [], 0
            for x, y in zip(before, after):
                starts.append(at)
                at += y - x
            found = self.known[w] = (before, after, starts)
        return found

    def pieces(self, source: int, place: int, size: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of a document that takes places place .. place + size of its queue."""
        out, at, stop = [], place, place + size
        w = self.queues.rank(source, place) // self.window
        while at < stop:
            before, after, starts = self.of(w)
            end = min(stop, after[source])
            if end > at:
                start, length, offset = at - place, end - at, starts[source] + at - before[source]
                if w < self.last:
                    out.append((start, length, w, offset))
                else:
                    lo, sequence = 0, w
                    for n in cut_last(self.whole - self.last * self.window, self.window):
                        a, b = max(offset, lo), min(offset + length, lo + n)
                        if a < b:
                            out.append((start + a - offset, b - a, sequence, a - lo))
                        lo, sequence = lo + n, sequence + 1
                at = end
            w += 1
        return out


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(part, g, at, doc_id, n, ids): each row's ids with `end` after them, and its place in its partition's part of its
    source's queue."""
    code = code_of(path)
    tail = np.array([end], np.dtype(code)).tobytes()

    def encode(batches):
        part, queue = TaskContext.get().partitionId(), {}
        width = len(tail)
        for batch in slices(batches):
            groups, at, ids = batch.column(1).to_pylist(), [], []
            for g, text in zip(groups, batch.column(2).to_pylist()):
                data = packed_ids(text, path, code) + tail
                at.append(queue.get(g, 0))
                queue[g] = at[-1] + len(data) // width
                ids.append(data)
            n = [len(x) // width for x in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(n), pa.int32()), batch.column(1), pa.array(at, pa.int64()), batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                ["part", "g", "at", "doc_id", "n", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group_key(F.col("source")).alias("g"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(encode, "part int, g string, at long, doc_id long, n long, ids binary")


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END, with_ids: bool = False, weights: dict | None = None) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids_crc32 (of its ids as unsigned
    little-endian 32-bit numbers), doc_tokens (with `end`), sequence_id, offset (its place in the sequence); with_ids adds
    the ids themselves, as such bytes.

    weights: target weights of sources (None for the null source; sources that are left out come last); by default each
    source's part of all tokens. Every window has the target proportions of the queues that haven't ended.

    Every id is in one piece. Sequences 0, 1, ... hold `window` tokens, the last ones powers of two. Null and empty texts
    have the one id `end`. A null source is a queue of its own. Repeated rows are packed each for itself, so a doc_id, null
    as well, may come several times. Texts of any length are encoded whole. An empty table gives no rows; columns beside
    doc_id, text and source are not read."""
    path = path or default_path()
    spark = docs.sparkSession
    small_batches(spark)
    rows = written(encoded(docs, path, end))
    sums = rows.groupBy("g", "part").agg(F.sum("n").alias("n"))  # a number for each input partition and source
    queue = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = small(sums.select(F.col("g").alias("__g"), F.col("part").alias("__part"), "n", F.coalesce(F.sum("n").over(queue), F.lit(0)).alias("first")))
    totals = {r["__g"]: r.n for r in first.groupBy("__g").agg(F.sum("n").alias("n")).collect()}  # a number for each source
    names = sorted(totals)
    given = None if weights is None else {"t" if s is None else f"s{s}": round(w * 10**6) for s, w in weights.items()}
    queues = Queues(tuple(totals[g] for g in names), given and tuple(given.get(g, 0) for g in names))
    shared = spark.sparkContext.broadcast((queues, {g: i for i, g in enumerate(names)}))
    code = code_of(path)

    def cut(batches):
        queues, number = shared.value
        schedule = Schedule(queues, window)
        for batch in slices(batches):
            group, at, doc, size, ids = (batch.column(i).to_pylist() for i in range(5))
            out, parts = [], []
            for g, a, d, n, data in zip(group, at, doc, size, ids):
                wide = np.frombuffer(data, np.dtype(code)).astype("<u4").tobytes()
                for start, length, sequence, offset in schedule.pieces(number[g], a, n):
                    mine = wide[4 * start : 4 * (start + length)]
                    out.append((d, start, length, zlib.crc32(mine), n, sequence, offset))
                    if with_ids:
                        parts.append(mine)
            columns = [pa.array([x[i] for x in out], pa.int64()) for i in range(7)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * with_ids, [c.split()[0] for c in OUT.split(", ")] + ["ids"] * with_ids)

    placed = rows.join(first, (F.col("g") == F.col("__g")) & (F.col("part") == F.col("__part")))
    placed = placed.select("g", (F.col("first") + F.col("at")).alias("at"), "doc_id", rows["n"].alias("n"), "ids")
    return placed.mapInArrow(cut, OUT + ", ids binary" * with_ids)
