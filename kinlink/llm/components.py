"""Connected components by alternating large and small stars, with no neighbour list ever gathered.

Each round replaces the edges by stars that keep the components: first every larger neighbour of a vertex is tied to the
smallest vertex around it, then every smaller one. Rounds end when the edges stay the same; their number grows with the
logarithm of the longest path. Only sums and minima are taken per vertex, so a hub costs no more than its edges; the
minima are kept tables, so the joins with them are broadcast up to a checked size, and beyond it are plain joins of two
exchanges, which adaptive execution splits where a hub has most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import checkpoint, small


def _done(edges: DataFrame) -> bool:
    """Whether the edges are stars already: each u has one edge, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    found = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))
    return not found.agg(F.count(F.lit(1))).head()[0]


def stars(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs -> (u, v): each vertex u but the smallest of its component, and that smallest one as v.
    Loops, repeats and either direction are allowed; no edges give no rows."""
    now = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _done(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = small(both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m")))
        large = both.where("v > u").join(around, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = small(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")))
        tied = large.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(tied.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
    return now
