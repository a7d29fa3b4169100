"""Probabilistic linkage: comparison levels, m and u, match weights and probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.functions.similarity import jaro, jaro_winkler
from kinlink.operators.labels import random_pairs

LEVELS = (0.95, 0.9, 0.7)
COMPARISONS = ("name", "addr", "country")


def _graded(similarity: Column, equal: Column, levels) -> Column:
    """The level: the number of thresholds and equality at the top, 0 below all, -1 for null."""
    out = F.lit(0)
    for i, t in enumerate(sorted(levels), 1):
        out = F.when(similarity >= t, i).otherwise(out)
    return F.when(similarity.isNull(), -1).when(equal, len(levels) + 1).otherwise(out).cast("int")


def gammas(pairs: DataFrame, left: DataFrame, right: DataFrame, levels=LEVELS) -> DataFrame:
    """pairs with gamma_name, gamma_addr and gamma_country. Empty strings count as null."""
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    side = lambda d, s: d.select(F.col("entity_id").alias(f"entity_id_{s}"), empty("name_norm").alias(f"name_{s}"), empty("addr_norm").alias(f"addr_{s}"), F.col("country_norm").alias(f"country_{s}"))
    met = pairs.join(side(left, "l"), "entity_id_l").join(side(right, "r"), "entity_id_r")
    met = met.withColumns({f"j_{c}": jaro(F.col(f"{c}_l"), F.col(f"{c}_r")) for c in ("name", "addr")})
    graded = {f"gamma_{c}": _graded(jaro_winkler(F.col(f"{c}_l"), F.col(f"{c}_r"), F.col(f"j_{c}")), F.col(f"{c}_l") == F.col(f"{c}_r"), levels) for c in ("name", "addr")}
    same = F.col("country_l") == F.col("country_r")
    graded["gamma_country"] = F.when(same.isNull(), -1).otherwise(same.cast("int")).cast("int")
    return met.withColumns(graded).select(*pairs.columns, *graded)


def level_shares(graded: DataFrame) -> DataFrame:
    """(comparison, level, n, share) of each comparison's levels that aren't null: m from true pairs, u from random ones."""
    rows = graded.select(F.explode(F.array(*[F.struct(F.lit(c).alias("comparison"), F.col(f"gamma_{c}").alias("level")) for c in COMPARISONS])).alias("x")).select("x.*").where("level >= 0")
    n = rows.groupBy("comparison", "level").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("comparison").agg(F.sum("n").alias("all"))
    return n.join(total, "comparison").select("comparison", "level", "n", (F.col("n") / F.col("all")).alias("share"))


def table(shares: DataFrame) -> dict[str, dict[int, float]]:
    """level_shares() on the driver: a handful of rows."""
    out: dict[str, dict[int, float]] = {c: {} for c in COMPARISONS}
    for r in shares.collect():
        out[r.comparison][r.level] = r.share
    return out


def prior(n_true: int, n_left: int, n_right: int) -> float:
    return n_true / max(1, n_left * n_right)


def predict(graded: DataFrame, m: dict, u: dict, prior_: float, floor: float = 1e-6) -> DataFrame:
    """graded with match_weight (log2 of the odds) and match_probability. A null level weighs nothing; a share that was
    never seen counts as floor."""
    prior_ = min(max(prior_, 1e-12), 1 - 1e-12)
    weight = F.lit(math.log2(prior_ / (1 - prior_)))
    for c in COMPARISONS:
        part = F.lit(0.0)
        for level in sorted(set(m[c]) | set(u[c])):
            part = F.when(F.col(f"gamma_{c}") == level, math.log2(max(m[c].get(level, 0), floor) / max(u[c].get(level, 0), floor))).otherwise(part)
        weight = weight + part
    return graded.withColumn("match_weight", weight).withColumn("match_probability", 1 / (1 + F.pow(F.lit(2.0), -F.col("match_weight"))))


def link(left: DataFrame, right: DataFrame, pairs: DataFrame, truth: DataFrame, random: DataFrame | None = None, draws: int = 1_000_000) -> DataFrame:
    """Estimate u on random pairs (drawn here, if none are given), m on the truth, the prior from both sides' sizes, and
    score the candidates."""
    true = truth.select("entity_id_l", "entity_id_r").distinct()
    random = random_pairs(left, right, draws) if random is None else random
    m = table(level_shares(gammas(true, left, right)))
    u = table(level_shares(gammas(random.select("entity_id_l", "entity_id_r"), left, right)))
    return predict(gammas(pairs, left, right), m, u, prior(true.count(), left.count(), right.count()))
