"""Decisions on scored pairs (entity_id_l, entity_id_r, prob): a flat threshold, or three thresholds per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flat(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where(F.col("prob") >= threshold)


def three_threshold(scored: DataFrame, singleton: float, keep: float, fallback: float, scope: str = "joint", ties: str = "all") -> DataFrame:
    """Of each entity: nothing if its best is below `singleton`; all pairs from `keep` on if the best reaches it; else the
    best if it reaches `fallback`. scope "source" decides for each src by itself; ties "one" keeps one best (by
    entity_id_r, then src), "all" keeps all of them. With singleton < fallback the first cut changes nothing."""
    by = ["entity_id_l"] + (["src"] if scope == "source" else [])
    best = F.max("prob").over(Window.partitionBy(*by))
    order = Window.partitionBy(*by).orderBy(F.desc("prob"), *([] if ties == "all" else ["entity_id_r", *[c for c in ("src",) if c in scored.columns]]))
    place = (F.dense_rank() if ties == "all" else F.row_number()).over(order)
    ranked = scored.withColumns({"__best": best, "__place": place})
    chosen = (F.col("__best") >= singleton) & F.when(F.col("__best") >= keep, F.col("prob") >= keep).otherwise((F.col("__best") >= fallback) & (F.col("__place") == 1))
    return ranked.where(chosen).drop("__best", "__place")


def top1(scored: DataFrame, by: str = "entity_id_l") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("prob"), "entity_id_r")
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
