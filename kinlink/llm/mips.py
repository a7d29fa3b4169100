"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound with a shared kth score.

Rows are dealt into shards by a hash. A query is asked in one shard first, then in an eighth of all, then in the rest; its
kth score so far, a lower bound of the final one, goes along each time. In a shard a node of the ball tree (centre
c, radius r) can hold no inner product above q.c + |q| r: nodes below the score are cut from the root down, the remaining
leaves are read in the order of that bound, and a query stops at the first leaf that cannot reach its current kth score.
Components are whole numbers, so scores are exact and bounds need no more than a rounding allowance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.ann import K, matrix, ranked, tiles, usable
from kinlink.llm.common import checkpoint

BLOCK, QUERY_BLOCK, LEAF = 8192, 2048, 64
LOWEST = -(2**63)


class BallTree:
    """Rows halved along the direction to the row farthest from the mean, down to leaves of LEAF rows."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.rows, self.centre, self.radius, self.child, self.span = rows, [], [], [], []
        self.order = np.arange(len(rows))
        self._grow(0, len(rows), leaf)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _grow(self, lo: int, hi: int, leaf: int) -> int:
        at = self.order[lo:hi]
        part = self.rows[at]
        centre = part.mean(axis=0)
        far = np.sqrt(((part - centre) ** 2).sum(axis=1))
        me = len(self.child)
        self.centre.append(centre)
        self.radius.append(float(far.max()) * (1 + 1e-9) + 1e-6)
        self.child.append(())
        self.span.append((lo, hi))
        if hi - lo > leaf:
            mid = (lo + hi) // 2
            along = part @ (part[int(far.argmax())] - centre)
            self.order[lo:hi] = at[np.argpartition(along, mid - lo)]
            self.child[me] = (self._grow(lo, mid, leaf), self._grow(mid, hi, leaf))
        return me


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a (n, d) and b (n, m, d) -> (n, m) whole numbers as int64, held to its range."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return np.matmul(b, a[:, :, None])[:, :, 0].astype(np.int64)
    wide = [[sum(int(x) * int(y) for x, y in zip(row, q)) for row in rows] for q, rows in zip(a, b)]
    return np.array([[min(max(x, LOWEST), 2**63 - 1) for x in row] for row in wide], np.int64).reshape(b.shape[:2])


def drop_repeats(score: np.ndarray, place: np.ndarray, cid: np.ndarray) -> None:
    """Leaves one entry of each id in a row, the best; the others are emptied."""
    order = np.lexsort((place, ~score), axis=1)
    for row, columns in enumerate(order.tolist()):
        seen = set()
        for x in columns:
            at = place[row, x]
            if at < len(cid):
                if int(cid[at]) in seen:
                    score[row, x], place[row, x] = LOWEST, len(cid)
                seen.add(int(cid[at]))


def shard_top(qid, q, known, cid, c, k: int = K, leaf: int = LEAF) -> list[tuple[int, int, int]]:
    """(query, candidate, score): the k best of each query in this shard, except what lies below its known kth score."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    tree = BallTree(c, leaf)
    length = np.sqrt((q**2).sum(axis=1))
    bound = q @ tree.centre.T + length[:, None] * tree.radius[None]
    bound += 1e-9 * np.abs(bound) + 1.0
    open_ = np.zeros(bound.shape, bool)
    open_[:, 0] = bound[:, 0] >= known
    leaves = []
    for node, child in enumerate(tree.child):  # children come after their parents
        if not child:
            leaves.append(node)
        for x in child:
            open_[:, x] = open_[:, node] & (bound[:, x] >= known)
    width = max(hi - lo for lo, hi in (tree.span[x] for x in leaves))
    member = np.full((len(leaves), width), -1)
    for i, x in enumerate(leaves):
        lo, hi = tree.span[x]
        member[i, : hi - lo] = tree.order[lo:hi]
    reach = np.where(open_[:, leaves], bound[:, leaves], -np.inf)
    by = np.argsort(-reach, axis=1)
    score = np.full((len(q), k), LOWEST)
    place = np.full((len(q), k), len(cid))  # ids ascend with the place, so a smaller place wins a tie
    floor = known.astype(np.float64).copy()
    live = np.arange(len(q))
    repeats = len(np.unique(cid)) < len(cid)
    for step in range(len(leaves)):
        at = by[live, step]
        go = (reach[live, at] > -np.inf) & (reach[live, at] >= floor[live])
        live, at = live[go], at[go]
        if not len(live):
            break
        for lo in range(0, len(live), 256):
            a, rows = live[lo : lo + 256], member[at[lo : lo + 256]]
            s = dots(q[a], c[rows])
            s[(rows < 0) | (cid[rows] == qid[a][:, None])] = LOWEST
            p = np.where(s == LOWEST, len(cid), rows)
            s, p = np.concatenate([score[a], s], axis=1), np.concatenate([place[a], p], axis=1)
            if repeats:
                drop_repeats(s, p, cid)
            best = np.lexsort((p, ~s), axis=1)[:, :k]
            score[a], place[a] = np.take_along_axis(s, best, 1), np.take_along_axis(p, best, 1)
            floor[a] = np.maximum(floor[a], score[a, -1])
    i, j = np.nonzero(place < len(cid))
    return list(zip(qid[i].tolist(), cid[place[i, j]].tolist(), score[i, j].tolist()))


def top_products(vectors: DataFrame, every: int = 50, k: int = K, scale: float = 256, idcol: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each query (id divisible by `every`) the k largest inner products among all other rows, with components taken
    as floor(scale * x): query_id, rank from 1, vec_id, score (long).

    Vectors that are null, empty or hold null or non-finite components take no part; zero vectors do. Vectors of
    different lengths are never compared. Scores beyond a long are held to its range; of equal ones the smaller vec_id
    comes first. A row repeated with its id and vector counts once, rows that share an id by their best score. An empty table gives no rows."""

    def searched(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = shard_top(left.vec_id.to_numpy(), matrix(left.v), left.known.to_numpy(), right.vec_id.to_numpy(), matrix(right.v), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    rows = usable(vectors, idcol, vector, nonzero=False).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))
    rows = checkpoint(rows.distinct())
    q, c, blocks = tiles(rows, every, block, query_block)
    keys, shape = ["dim", "q", "c"], "query_id long, vec_id long, score long"
    none = F.lit(LOWEST)
    turn = F.pmod(F.col("c") - F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)), F.lit(blocks))  # a query's shards in order
    ends = sorted({1, -(-blocks // 8), blocks})  # its first, an eighth of all, the rest
    found = None
    for lo, hi in zip([0, *ends], ends):
        asked = q.where((turn >= lo) & (turn < hi))
        if found is None:
            told = asked.withColumn("known", none)
        else:
            kth = ranked(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("__q"), F.col("score").alias("__known"))
            told = asked.join(kth, F.col("vec_id") == F.col("__q"), "left").withColumn("known", F.coalesce("__known", none)).select("dim", "q", "c", F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), "known")
        more = told.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(searched, shape)
        both = (more if found is None else found.unionByName(more)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        found = both if hi == blocks else checkpoint(ranked(both, k).select("query_id", "vec_id", "score"))
    return ranked(found, k)
