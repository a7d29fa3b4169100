"""Near copies for the pipeline: SimHash links, and texts whose sets of five-word shingles have a Jaccard of 0.8 or more.

Fingerprints alone can't give the second: at a Jaccard of 0.8 two of them differ in about 10 of 64 bits, and at that radius
no vantage-point bound prunes random ones, which lie 32 +- 4 apart. So candidates beyond simhash.RADIUS come from MinHash,
and vantage points in the exact Jaccard distance, which is a metric, settle them:

1. One pass over the texts gives each its fingerprint, 128 minima over its set of shingles, kept as one byte each, and
   BANDS keys of BAND minima. Documents alike in all of this become one row.
2. Rows that share a key meet in a cell: at a Jaccard of 0.8 all but 0.2 % of the pairs share one.
3. In a bucket over SHARD rows all rows within SURE of a leader are tied to it, and only the others, dealt into blocks,
   are compared with all. A large group of near copies so costs a row's work a row.
4. In its cell every pair is looked at. Pairs of SURE equal bytes or more are links (the Jaccard is then over 0.8 but for
   one in three thousand of those just below it); a spanning forest of them leaves the task. Rows with a pair from LEAST
   on that is no such link, and isn't joined by such links, go on to step 5; cells with the same such rows are one.
5. There the rows meet with their whole sets. Distances to a few vantage points are measured; by the triangle inequality
   they settle many pairs (apart if |d(x, v) - d(y, v)| > 0.2, a link if d(x, v) + d(y, v) <= 0.2). All others are
   measured, the heaviest first, unless links found on the way have joined them. No pair is left out by an estimate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import simhash
from kinlink.llm.common import checkpoint, release, slices, small, small_batches, written
from kinlink.llm.components import stars

WIDTH, JACCARD = 5, 0.8
MINIMA, BANDS, BAND, SHARD = 128, 12, 4, 2048
LEAST, SURE, VANTAGE = 86, 118, 8
_RNG = np.random.default_rng(23)
_TIMES, _PLUS = (_RNG.integers(0, 1 << 64, MINIMA, np.uint64) | np.uint64(1))[:, None], _RNG.integers(0, 1 << 64, MINIMA, np.uint64)[:, None]


def shingles(data: bytes) -> np.ndarray:
    """The set of a text's shingles as sorted hashes."""
    found = list(simhash.shingle_hashes(data.lower().split(), WIDTH))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[None, at : at + 1024] * _TIMES + _PLUS).min(axis=1))
    return least


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, whole, sig, keys) of each row that has an id: the fingerprint, a digest of the set of shingles, a byte
    a minimum, bands. Without words whole and sig are empty and there are no keys; null text is empty."""

    def made(batches):
        release()
        for batch in slices(batches):
            fps, whole, sig, keys, ends = [], [], [], [], [0]
            for text in batch.column(1).to_pylist():
                fps.append(simhash.fingerprint(text))
                hashes = shingles(text)
                if len(hashes):
                    least = minima(hashes)
                    whole.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    sig.append((least & np.uint64(255)).astype(np.uint8).tobytes())
                    keys += [xxhash.xxh64_intdigest(least[BAND * b : BAND * b + BAND].tobytes(), b) for b in range(BANDS)]
                else:
                    whole.append(b"")
                    sig.append(b"")
                ends.append(len(keys))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64)))
            columns = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(whole, pa.binary()), pa.array(sig, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "whole", "sig", "keys"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(made, "doc_id long, fp long, whole binary, sig binary, keys array<long>")


def _matrix(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, MINIMA)


def _equal(a: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for x, y in a:
        yield pa.array(np.count_nonzero(_matrix(x.to_pylist()) == _matrix(y.to_pylist()), axis=1), pa.int32())


def pairs(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, equal bytes) of the pairs i < j of LEAST equal bytes or more."""
    out = [(np.zeros(0, np.int32),) * 2 + (np.zeros(0, np.int16),)]
    for i in range(len(sig) - 1):
        same = np.count_nonzero(sig[i + 1 :] == sig[i], axis=1)
        j = np.flatnonzero(same >= LEAST)
        if len(j):
            out.append((np.full(len(j), i, np.int32), (j + i + 1).astype(np.int32), same[j].astype(np.int16)))
    return tuple(np.concatenate(c) for c in zip(*out))


def cells(unique: DataFrame, shard: int = SHARD) -> tuple[DataFrame, DataFrame | None]:
    """unique (first, sig, keys) -> rows (key, a, b, first, sig) by the cell in which they are compared, and edges (u, v) of
    rows to the leaders of large buckets, if there are any."""
    routed = unique.select("first", "sig", F.explode("keys").alias("key"))
    counted = routed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("lead"))
    met = small(counted.where("n > 1"))
    few = routed.join(met.where(F.col("n") <= shard).select("key"), "key", "left_semi").select("key", F.lit(0).alias("a"), F.lit(0).alias("b"), "first", "sig")
    large = met.where(F.col("n") > shard)
    if large.isEmpty():
        return few, None
    led = large.join(unique.select(F.col("first").alias("lead"), F.col("sig").alias("lead_sig")), "lead")
    rows = routed.join(led, "key").withColumn("m", F.arrow_udf(_equal, "int")("sig", "lead_sig"))
    rows = checkpoint(rows.select("key", "n", "lead", "first", "sig", "m", (F.col("m") < SURE).alias("far")))
    tied = rows.where(~F.col("far") & (F.col("first") != F.col("lead"))).select(F.col("first").alias("u"), F.col("lead").alias("v"))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(shard)).cast("int")
    others = rows.where("far").groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n_far"))
    rows = rows.join(others, F.col("key") == F.col("k")).withColumns({"all": blocks("n"), "rest": blocks("n_far")})
    own = F.pmod(F.xxhash64("first"), F.when(F.col("far"), F.col("rest")).otherwise(F.col("all"))).cast("int")
    cell = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    near = F.transform(span("rest"), lambda r: cell(r, F.col("own")))
    far = F.concat(F.transform(span("all"), lambda j: cell(F.col("own"), j)), F.transform(span("rest"), lambda r: cell(F.least(r, F.col("own")), F.col("all") + F.greatest(r, F.col("own")))))
    dealt = rows.withColumn("own", own).select("key", "first", "sig", F.explode(F.when(F.col("far"), far).otherwise(near)).alias("p"))
    return few.unionByName(dealt.select("key", "p.a", "p.b", "first", "sig")), tied


def _by_cell(batches, width: int) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """Batches sorted by their first `width` columns -> each cell and its other columns."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        name = [np.asarray(batch.column(i)) for i in range(width)]
        starts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in name], axis=0)) + 1).tolist()]
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            cell = tuple(int(x[lo]) for x in name)
            if held and cell != now:
                yield now, [pa.chunked_array(c) for c in zip(*held)]
                held = []
            now = cell
            held.append([batch.column(i).slice(lo, hi - lo) for i in range(width, batch.num_columns)])
    if held:
        yield now, [pa.chunked_array(c) for c in zip(*held)]


def looked_at(placed: DataFrame) -> DataFrame:
    """(key, a, b, first, sig) -> (u, v, cell, sig): without a cell, links of a spanning forest of each cell's sure pairs;
    with one, the rows u that have a doubtful pair there, and the smallest row v that sure pairs tie them to."""
    names = {"u": pa.int64(), "v": pa.int64(), "cell": pa.int64(), "sig": pa.binary()}

    def found(batches):
        release()
        out = []
        for _, (first, sig) in _by_cell(batches, 3):
            if len(first) < 2:
                continue
            ids, bits = first.to_numpy(), _matrix(sig.to_pylist())
            i, j, same = pairs(bits)
            sure = same >= SURE
            root = simhash.roots(len(ids), i[sure], j[sure])
            out += [(int(ids[x]), int(ids[root[x]]), None, None) for x in np.flatnonzero(root != np.arange(len(ids)))]
            doubtful = root[i] != root[j]
            rows = np.unique(np.concatenate([i[doubtful], j[doubtful]]))
            if len(rows):
                home = ids[root[rows]]
                cell = np.array(xxhash.xxh64_intdigest(np.concatenate([ids[rows], home]).tobytes()), np.uint64).view(np.int64)
                out += [(int(x), int(h), int(cell), s.tobytes()) for x, h, s in zip(ids[rows], home, bits[rows])]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), names.values())], list(names))
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), names.values())], list(names))

    dealt = placed.select("key", "a", "b", "first", "sig").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "first")
    return dealt.mapInArrow(found, "u long, v long, cell long, sig binary")


def distance(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sets, as sorted distinct hashes: 1 - Jaccard."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 1 - both / (len(x) + len(y) - both)


def joined(sig: np.ndarray, home: np.ndarray, sets: list[np.ndarray], counted: list | None = None) -> list[tuple[int, int]]:
    """(i, j): links of a Jaccard of JACCARD or more, with which every pair that has one, and LEAST equal bytes, is in one
    group; rows of the same home are in one group from the start. counted gets the number of distances measured."""
    most, n = 1 - JACCARD, len(sets)
    i, j, same = pairs(sig)
    root = simhash.roots(n, *_ties(home))
    out, measured = [], 0
    if n > VANTAGE:
        vantage, far = [], np.full(n, np.inf)
        for _ in range(min(VANTAGE, n // VANTAGE)):  # the next vantage point lies farthest from those before
            v = int(np.bincount(np.concatenate([i, j]), minlength=n).argmax()) if not vantage else int(far.argmax())
            vantage.append(np.array([distance(sets[v], x) for x in sets]))
            far = np.minimum(far, vantage[-1])
            measured += n
            near = np.flatnonzero(vantage[-1] <= most + 1e-12)
            out += [(v, int(x)) for x in near if x != v]
        d = np.stack(vantage)
        root = simhash.roots(n, *(np.concatenate([a, b]) for a, b in zip(_ties(home), np.array(out, int).reshape(-1, 2).T)))
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            apart = np.abs(d[:, i[s]] - d[:, j[s]]).max(axis=0) > most + 1e-9
            same[s][apart] = 0
    keep = np.flatnonzero((same >= LEAST) & (root[i] != root[j]))
    keep = keep[np.argsort(-same[keep], kind="stable")]
    for at in range(0, len(keep), 1 << 14):
        part = keep[at : at + (1 << 14)]
        for x, y in zip(i[part].tolist(), j[part].tolist()):
            if root[x] == root[y]:
                continue
            a, b = len(sets[x]), len(sets[y])
            if min(a, b) < JACCARD * max(a, b):
                continue
            measured += 1
            if distance(sets[x], sets[y]) <= most + 1e-12:
                out.append((x, y))
                root[root == root[y]] = root[x]
    if counted is not None:
        counted.append(measured)
    return out


def _ties(home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one home as edges to its first row."""
    _, first, at = np.unique(home, return_index=True, return_inverse=True)
    return np.arange(len(home)), first[at]


def settled(docs: DataFrame, doubtful: DataFrame) -> DataFrame:
    """Rows of looked_at() with a cell -> (u, v): links of a Jaccard of JACCARD or more that settle all their pairs. A
    cell's sets are in memory together; its pairs are not rows of a table."""

    def linked(batches):
        release()
        for _, (first, home, sig, sets) in _by_cell(batches, 1):
            ids, whole = first.to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in sets]
            found = joined(_matrix(sig.to_pylist()), home.to_numpy(), whole)
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["u", "v"])

    rows = doubtful.dropDuplicates(["cell", "u"])
    known = whole_sets(docs, small(doubtful.select("u").distinct()))
    met = rows.join(known, F.col("u") == F.col("id")).select("cell", "u", "v", "sig", "set")
    return met.repartition("cell").sortWithinPartitions("cell", "u").mapInArrow(linked, "u long, v long")


def whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set): the sets of shingles of the documents u of ids; of repeated rows one."""

    def sets(batches):
        release()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["id", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return written(rows.join(ids, F.col("id") == F.col("u"), "left_semi").mapInArrow(sets, "id long, set binary"))


def grouped(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(u, v): each doc_id that is not the smallest of its group of linked documents, and that smallest one.

    Links are pairs of fingerprints within simhash.RADIUS bits and pairs of a Jaccard of JACCARD or more. A text of under
    five words is one shingle; texts without words, null ones too, link to each other only. Texts of any length are read
    whole. Rows that share an id are one document. Rows with a null id take no part; an empty table gives no rows;
    columns beside doc_id and text are not read."""
    release()  # the driver's Python too holds what an earlier stage's training took
    rows = written(sketches(docs))
    unique = written(rows.groupBy("fp", "whole", "sig", "keys").agg(F.min("doc_id").alias("first")))
    placed, tied = cells(unique.select("first", "sig", "keys"), shard)
    seen = written(looked_at(placed))
    edges = [simhash.links(unique.select("fp", "first")), seen.where("cell is null").select("u", "v"), settled(docs, seen.where("cell is not null")), tied]
    own = rows.select("doc_id", "fp", "whole").join(unique.select(F.col("fp").alias("f"), F.col("whole").alias("w"), "first"), (F.col("fp") == F.col("f")) & (F.col("whole") == F.col("w"))).select("doc_id", "first")
    again = small(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("d")))
    if not again.isEmpty():  # an id with several texts ties their groups
        edges.append(own.join(again, F.col("doc_id") == F.col("d"), "left_semi").select(F.col("doc_id").alias("u"), F.col("first").alias("v")))
    homes = stars(reduce(DataFrame.unionByName, [e for e in edges if e is not None]))
    found = own.join(homes, F.col("first") == F.col("u"), "left").select("doc_id", F.coalesce("v", "first").alias("v"))
    return found.where("doc_id <> v").select(F.col("doc_id").alias("u"), "v").distinct()


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with one row of each group kept, that of its smallest doc_id; of repeated rows with that id one stays.
    Rows with a null doc_id all stay. All columns of docs come back and no others."""
    return simhash.without(docs, grouped(docs).select(F.col("u").alias("doc_id")))
