"""Near duplicates by SimHash: exact links of fingerprints within RADIUS bits, found with vantage-point trees.

A fingerprint links to others at RADIUS = 3 or fewer differing bits. How the pairs are found, with no link lost:

1. Equal fingerprints become one row with their smallest doc_id; only these rows go on.
2. Two fingerprints within 3 bits have a half of 32 bits in which they differ by at most REACH = 1. So there is a
   vantage-point tree over each half, with that as its radius: whole fingerprints lie 32 +- 4 bits apart, and a margin of
   3 there would send 27 rows of 100 to both sides of every median; a margin of 1 on 32 bits sends 14.
3. The trees grow on the driver from a sample of at most one in SHARE fingerprints, SAMPLE in all, drawn by a hash. A node has a vantage point
   and a distance m; rows at most m + REACH away go inside, rows more than m away outside. By the triangle inequality,
   |d(x, v) - d(y, v)| <= d(x, y), every pair within REACH meets on a side. Rows near the boundary are in both.
   Leaves that the whole table fills beyond CELL rows grow on from a sample of theirs, up to ROUNDS times; the trees have
   some SAMPLE / 8 nodes at most.
4. Each leaf is a shard. Its task grows the tree on over all its rows, down to LEAF, with the same bounds; what is left
   there is compared over all 64 bits. Only a spanning forest leaves the task: at most one edge a row.
5. A shard that no vantage point divides (a group of near copies with one half alike) and that is over CELL rows is dealt
   into pairs of blocks, and so is any other over LARGE rows (28 MB): no task ever holds more than two blocks.
6. Connected components by alternating stars (components.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm.common import checkpoint, release, slices, small, small_batches
from kinlink.llm.components import stars

WIDTH, SEED, RADIUS, REACH = 3, 42, 3, 1
SHARD, CELL, LARGE, LEAF = 2048, 32_768, 1 << 20, 96
SAMPLE, SHARE, ROUNDS, TRIES = 1 << 20, 8, 3, 6


def shingle_hashes(words: list[bytes], width: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """The XXH64 of each shingle of `width` words, repeats included, in arrays of bounded size; fewer words make one
    shingle, none give nothing."""
    joined = b" ".join(words)
    if len(words) <= width:
        if words:
            yield np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
        return
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size).tolist(), ends.tolist()
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    for at in range(0, n, 1 << 15):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : min(n, at + (1 << 15))], ends[at + width - 1 :])], np.uint64)


def fingerprint(data: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """The SimHash of a text as an unsigned integer: A-Z lower-cased, words cut at ASCII white space, shingles of `width`
    words with repeats; no words give 0. A bit is set if over half the hashes have it."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data.lower().split(), width, seed):
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id long, fp long): a fingerprint for each row; the long has the bits of the unsigned one. Null text is empty."""

    def scored(batches):
        release()
        for batch in slices(batches):
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, fp long")


def halves(fps: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) -> their low and high halves as two rows of uint32."""
    return np.stack([fps.astype(np.uint32), (fps >> np.uint64(32)).astype(np.uint32)])


def divided(values: np.ndarray, reach: int = REACH, tries: int = TRIES) -> tuple[int, int] | None:
    """The vantage point and distance that leave the larger side of `values` smallest; None where neither side loses a
    tenth. The vantage points tried are values themselves, evenly spread."""
    n, best = len(values), None
    for at in range(tries):
        vantage = values[(2 * at + 1) * n // (2 * tries)]
        upto = np.cumsum(np.bincount(np.bitwise_count(values ^ vantage), minlength=33 + reach))
        larger = np.maximum(upto[reach:], n - upto[: len(upto) - reach])
        m = int(larger.argmin())
        if best is None or larger[m] < best[0]:
            best = (int(larger[m]), int(vantage), m)
    return best[1:] if best[0] <= 0.9 * n else None


class Trees:
    """The trees of both halves in one list of nodes: vantage point, distance, first of the two children (0 in a leaf).
    Nodes 0 and 1 are the roots; the inside child comes first."""

    def __init__(self):
        self.nodes: list[tuple[int, int, int]] = [(0, 0, 0)] * 2
        self.dense: set[int] = set()  # leaves that no vantage point divides

    def grow(self, leaf: int, values: np.ndarray, each: float, shard: int) -> None:
        """Divides a leaf by a sorted sample of its values, each of which stands for `each` rows, until a side has at
        most `shard` rows or the sample says too little."""
        stack = [(leaf, values)]
        while stack:
            node, part = stack.pop()
            grows = len(part) * each > shard and len(part) >= 16
            cut = divided(part) if grows else None
            if grows and not cut:
                self.dense.add(node)
            if cut:
                far = np.bitwise_count(part ^ np.uint32(cut[0]))
                self.nodes[node] = (*cut, len(self.nodes))
                stack += [(len(self.nodes), part[far <= cut[1] + REACH]), (len(self.nodes) + 1, part[far > cut[1]])]
                self.nodes += [(0, 0, 0)] * 2

    def leaves(self, values: np.ndarray, root: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf that a value has to visit."""
        rows, at = [], []
        stack = [(root, np.arange(len(values)))]
        while stack:
            node, part = stack.pop()
            vantage, m, child = self.nodes[node]
            if child and len(part):
                far = np.bitwise_count(values[part] ^ np.uint32(vantage))
                stack += [(child, part[far <= m + REACH]), (child + 1, part[far > m])]
            elif len(part):
                rows.append(part)
                at.append(np.full(len(part), node, np.int32))
        return (np.concatenate(rows), np.concatenate(at)) if rows else (np.zeros(0, int), np.zeros(0, np.int32))


def routed(unique: DataFrame, trees: Trees, blocks: dict[int, int] | None = None, only: set[int] | None = None) -> DataFrame:
    """unique (fp, first) -> (leaf, a, b, half, fp, first): each row in every leaf that it has to visit, or in those of
    `only`. A leaf with blocks is dealt out as their pairs (a, b); other rows have a = b = 0."""
    shared = unique.sparkSession.sparkContext.broadcast((trees, blocks or {}, only and np.array(sorted(only))))

    def found(batches):
        release()
        trees, blocks, only = shared.value
        for batch in slices(batches, 1 << 16):
            fp, first = (np.asarray(batch.column(i)) for i in range(2))
            for half, values in enumerate(halves(fp.astype(np.int64).view(np.uint64))):
                row, leaf = trees.leaves(values, half)
                if only is not None:
                    row, leaf = row[np.isin(leaf, only)], leaf[np.isin(leaf, only)]
                a = b = np.zeros(len(row), np.int32)
                if blocks:
                    n = np.array([blocks.get(x, 1) for x in leaf.tolist()], np.int64)
                    own = (((fp[row].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % n.astype(np.uint64)).astype(np.int32)
                    at = np.repeat(np.arange(len(row)), n)
                    other = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                    row, leaf, a, b = row[at], leaf[at], np.minimum(own[at], other), np.maximum(own[at], other)
                for lo in range(0, len(row), 1 << 16):
                    s = slice(lo, lo + (1 << 16))
                    columns = [leaf[s], a[s], b[s], np.full(len(row[s]), half, np.int32), fp[row[s]], first[row[s]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["leaf", "a", "b", "half", "fp", "first"])

    return unique.select("fp", "first").mapInArrow(found, "leaf int, a int, b int, half int, fp long, first long")


def planted(unique: DataFrame, shard: int = SHARD, cell: int = CELL, sample: int = SAMPLE) -> tuple[Trees, dict[int, int]]:
    """The trees over unique (fp, first), and the number of blocks of each leaf that stays over `cell` rows. What comes to
    the driver: at most one in SHARE fingerprints a round, some `sample` in all, and a row for each leaf over `cell`.
    Leaves that can be divided are left to their tasks up to LARGE rows."""
    trees, blocks = Trees(), {}
    rows = unique.count()
    full = {0: rows, 1: rows} if rows > shard else {}
    for turn in range(ROUNDS):
        if not full:
            break
        rate = min(1 / SHARE, sample / sum(full.values()))
        drawn = F.pmod(F.xxhash64("fp", F.lit(turn)), F.lit(1 << 24)) < int(rate * (1 << 24))
        held = routed(unique.where(drawn), trees, only=set(full)).select("leaf", "half", "fp").toArrow().sort_by("leaf")
        leaf, half, fp = (np.asarray(c) for c in held.columns)
        side = np.where(half == 0, *halves(fp.astype(np.int64).view(np.uint64)))
        size = len(trees.nodes)
        for x in sorted(full):
            trees.grow(x, np.sort(side[np.searchsorted(leaf, x) : np.searchsorted(leaf, x, "right")]), 1 / rate, shard)
        if len(trees.nodes) == size:
            break
        full = {r.leaf: r.n for r in routed(unique, trees).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).collect()}
    most = {x: cell if x in trees.dense else max(cell, LARGE) for x in full}
    return trees, {x: -(-2 * n // most[x]) for x, n in full.items() if n > most[x]}


def compared(values: np.ndarray, leaf: int = LEAF, reach: int = REACH) -> Iterator[np.ndarray]:
    """Groups of indices such that any two values within `reach` of each other are in a group: the leaves of a
    vantage-point tree over all values."""
    stack = [np.arange(len(values))]
    while stack:
        part = stack.pop()
        cut = divided(values[part], reach, 3) if len(part) > leaf else None
        if cut is None:
            yield part
        else:
            far = np.bitwise_count(values[part] ^ np.uint32(cut[0]))
            stack += [part[far <= cut[1] + reach], part[far > cut[1]]]


def near(a: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices i < j of the pairs of a within radius, in blocks of bounded size."""
    left, right = [], []
    step = max(1, (1 << 20) // max(1, len(a)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ a[None, at:]) <= radius)
        left.append(i[i < j] + at)
        right.append(j[i < j] + at)
    return np.concatenate(left), np.concatenate(right)


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n, by edges (u, v)."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        low = np.minimum(a, b)
        if (a == b).all():
            return root
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root != root[root]).any():
            root = root[root]


def linked(fps: np.ndarray, half: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among a shard's rows (uint64) whose halves are within REACH."""
    u, v = [np.zeros(0, int)], [np.zeros(0, int)]
    for part in compared(halves(fps)[half]):
        i, j = near(fps[part], radius)
        u.append(part[i])
        v.append(part[j])
    root = roots(len(fps), np.concatenate(u), np.concatenate(v))
    i = np.flatnonzero(root != np.arange(len(fps)))
    return i, root[i]


def edges(placed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """routed() -> (u, v): links of first ids whose components are those of all pairs within radius in a shard."""

    def found(batches):
        release()
        held = None
        for batch in batches:
            new = [np.asarray(batch.column(i)) for i in range(6)]
            rows = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new)]
            if not len(rows[0]):
                continue
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in rows[:3]], axis=0)) + 1
            starts = [0, *cuts.tolist()]
            for lo, hi in zip(starts, starts[1:]):
                yield made([x[lo:hi] for x in rows])
            held = [x[starts[-1] :] for x in rows]
        if held is not None and len(held[0]):
            yield made(held)

    def made(rows):
        i, j = linked(rows[4].astype(np.int64).view(np.uint64), int(rows[3][0]), radius)
        return pa.RecordBatch.from_arrays([pa.array(rows[5][i]), pa.array(rows[5][j])], ["u", "v"])

    dealt = placed.repartitionByRange("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b", "fp")  # even, as leaves are few
    return dealt.mapInArrow(found, "u long, v long")


def links(unique: DataFrame, radius: int = RADIUS, shard: int = SHARD, cell: int = CELL) -> DataFrame:
    """unique (fp, first) -> (u, v): links of first ids, with the components of all pairs of fingerprints within radius."""
    if radius > RADIUS:
        raise ValueError(f"the halves hold for at most {RADIUS} bits")
    return edges(routed(unique, *planted(unique, shard, cell)), radius)


def components(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, shard: int = SHARD, cell: int = CELL) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lower-case hex digits), component_id (the smallest doc_id that can
    be reached over links of at most `radius` differing bits, its own included).

    Null and empty texts have fingerprint 0 and link like any other; texts of one or two words have one shingle; texts of
    any length are read whole, in parts. Repeated rows come back as often as they came. A null doc_id keeps its row and
    is never a component_id unless the component has no other. An empty table gives an empty result. Columns beside
    doc_id and text are not read."""
    marked = checkpoint(fingerprints(docs, width))
    unique = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    homes = stars(links(unique.select("fp", F.col("fp").alias("first")), radius, shard, cell))  # fingerprints are the vertices
    homed = unique.join(homes, F.col("fp") == F.col("u"), "left").select("fp", "least", F.coalesce("v", "fp").alias("home"))
    least = homed.groupBy("home").agg(F.min("least").alias("component_id"))
    named = homed.join(least, "home").select(F.col("fp").alias("f"), "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, F.col("fp") == F.col("f")).select("doc_id", digits.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """The documents with one row of each component kept, that of its smallest doc_id; of repeated rows with that id one
    stays. Rows with a null doc_id all stay. All columns of docs come back and no others."""
    return without(docs, components(docs, width, radius).where("doc_id <> component_id").select("doc_id").distinct())


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose id is not in gone (doc_id, each once); of repeated rows with an id one stays, with a null
    id all."""
    ids = docs.select(F.col("doc_id").cast("long").alias("__id")).where("__id is not null")
    again = small(ids.groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__id"))
    gone = small(gone.select(F.col("doc_id").alias("__id")))
    same = F.col("doc_id").cast("long") == F.col("__id")
    kept = docs.join(gone, same, "left_anti")
    sortable = [F.col(c) for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant")]
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(*sortable))
    once = kept.join(again, same, "left_semi").withColumn("__row", first).where("__row = 1").drop("__row")
    return kept.join(again, same, "left_anti").unionByName(once)
