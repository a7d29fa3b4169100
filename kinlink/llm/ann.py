"""Nearest neighbours by cosine: a block matrix join on int8 tiles with error bounds.

Queries and candidates are dealt into blocks; each pair of blocks is a tile of bounded size, which one task computes. In
a tile every vector is scaled to length 1 and rounded to int8. The product of two such rows differs from the cosine by
at most |e_q| + |e_c| + |e_q||e_c| (e: the rounding error's length), so a candidate whose bound lies below the query's
current kth score is out. The rest are recomputed in double precision and kept in a heap of k per query; the heaps of the
tiles of a query are merged by rank. The result is exact; nothing is sampled, and no index has to be fitted."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm.common import checkpoint

K, QUERY_BLOCK, BLOCK = 5, 8192, 8192


def usable(vectors: DataFrame, idcol: str, vector: str, nonzero: bool) -> DataFrame:
    """(vec_id long, v array<double>): vectors that are not null or empty and hold only finite numbers, as told not 0."""
    rows = vectors.select(F.col(idcol).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def tiles(rows: DataFrame, every: int, block: int, query_block: int) -> tuple[DataFrame, DataFrame, int]:
    """Queries (vec_id divisible by `every`) and candidates with their tile (dim, q, c). A query goes to each block of
    candidates and a candidate to each block of queries; blocks are dealt by a hash of the id, so all are alike. Third: the number
    of blocks of candidates."""
    n = rows.count()
    blocks = max(1, -(-n // block), min(64, -(-n // 1024)))
    asked = max(1, -(-n // max(1, every * query_block)))
    own = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    q = rows.where(F.col("vec_id") % every == 0).select(F.size("v").alias("dim"), own(asked).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c"), "vec_id", "v")
    c = rows.select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("q"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("c"), "vec_id", "v")
    return q, c, blocks


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what rounding took away."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def scaled(m: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to 0.5 .. 1: squares neither overflow nor
    vanish, and cosines stay bit for bit what they are for rows whose squares wouldn't."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def tile_nearest(qid, q, cid, c, k: int = K) -> list[tuple[int, float, int]]:
    """(query, score, candidate) for the k nearest of each query in a tile, itself left out; ties to the smaller id."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], scaled(c[order])
    q = scaled(q)

    def parted(m):
        return quantised(m / np.linalg.norm(m, axis=1, keepdims=True))

    qc, qs, qe = parted(q)
    cc, cs, ce = parted(c)
    q2, c2 = np.sqrt(np.einsum("ij,ij->i", q, q)), np.sqrt(np.einsum("ij,ij->i", c, c))
    heaps: list[list] = [[] for _ in qid]
    repeats = len(np.unique(cid)) < len(cid)
    floor = np.full(len(qid), -np.inf)
    codes = qc.astype(np.float32)  # products of int8 are whole and below 2**24 for up to 1,000 dimensions: exact
    exact = q.shape[1] <= 1000
    cuts = [0, 16, 64, 256, *range(768, len(cid), 512)]  # short strips first, while the heaps have no floor yet
    for at, end in zip(cuts, [*cuts[1:], len(cid)]):
        part = cc[at:end]
        product = codes @ part.T.astype(np.float32) if exact else (qc.astype(np.float64) @ part.T.astype(np.float64))
        e = ce[at:end]
        high = product * (qs[:, None] * cs[None, at:end]) + (qe[:, None] + e[None] + qe[:, None] * e[None]) + 1e-6
        i, j = np.nonzero((high >= floor[:, None]) & (qid[:, None] != cid[None, at:end]))
        for lo in range(0, len(i), 1 << 17):
            a, b = i[lo : lo + (1 << 17)], j[lo : lo + (1 << 17)] + at
            score = np.einsum("ij,ij->i", q[a], c[b]) / (q2[a] * c2[b])
            may = score > floor[a]
            for x, s, y in zip(a[may].tolist(), score[may].tolist(), cid[b[may]].tolist()):
                entry, heap = (s, -y), heaps[x]
                if repeats and any(-e[1] == y for e in heap):  # an id with several vectors has one place, by its best score
                    heap[:] = [max(e, entry) if -e[1] == y else e for e in heap]
                    heapq.heapify(heap)
                elif len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        for x in np.unique(i).tolist():
            if len(heaps[x]) == k:
                floor[x] = heaps[x][0][0]
    return [(int(qid[x]), s, -y) for x, heap in enumerate(heaps) for s, y in heap]


def matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 1))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, vec_id, score), best first, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 50, k: int = K, idcol: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each query (id divisible by `every`) its k nearest by cosine among all other rows: query_id, rank from 1,
    vec_id, score (double, on the vectors as given).

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id.
    Finite components of any size are allowed. Of equal scores the smaller vec_id is nearer. Vectors of different lengths are never compared. Fewer candidates give fewer rows; an empty table gives none. A row
    repeated with its id and vector counts once; rows that share an id count by their best score."""

    def searched(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = tile_nearest(left.vec_id.to_numpy(), matrix(left.v), right.vec_id.to_numpy(), matrix(right.v), k)
        return pd.DataFrame(found, columns=["query_id", "score", "vec_id"])[["query_id", "vec_id", "score"]]

    rows = checkpoint(usable(vectors, idcol, vector, nonzero=True).distinct())
    q, c, _ = tiles(rows, every, block, query_block)
    keys = ["dim", "q", "c"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(searched, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return ranked(best, k)
