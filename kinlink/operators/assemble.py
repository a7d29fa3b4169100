"""Packed id lists per canonical entity, and their coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(pairs: DataFrame, column: str) -> DataFrame:
    """(entity_id_l, column): the sorted distinct partners joined by commas."""
    lists = pairs.groupBy("entity_id_l").agg(F.array_join(F.array_sort(F.collect_set("entity_id_r")), ",").alias(column))
    return lists


def id_lists(pairs: DataFrame, canonical: DataFrame, column: str = "matched_entity_ids", resort: bool = True) -> DataFrame:
    """(source1_entity_id, column): each canonical entity once; '' without partners. resort puts all partners in one
    order; otherwise those of S2 come before those of S3, each in order."""
    key = F.col("entity_id_r") if resort else F.struct(F.substring("entity_id_r", 1, 3).alias("s"), F.col("entity_id_r").alias("id"))
    ids = F.array_sort(F.collect_set(key))
    ids = ids if resort else F.transform(ids, lambda x: x["id"])
    lists = pairs.groupBy("entity_id_l").agg(F.array_join(ids, ",").alias(column))
    out = canonical.select("entity_id").distinct().join(lists.withColumnRenamed("entity_id_l", "entity_id"), "entity_id", "left")
    return out.select(F.col("entity_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def by_source(pairs: DataFrame) -> DataFrame:
    """(entity_id, s2, s3): lists of both sources side by side by a full outer join; null where one has none."""
    two = packed(pairs.where(F.col("entity_id_r").startswith("S2-")), "s2").withColumnRenamed("entity_id_l", "entity_id")
    three = packed(pairs.where(F.col("entity_id_r").startswith("S3-")), "s3").withColumnRenamed("entity_id_l", "entity_id")
    return two.join(three, "entity_id", "full")


def coverage(lists: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """Entities, those with at least one partner, and their share."""
    rows = lists.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum((F.col(column) != "").cast("long")), F.lit(0)).alias("matched"))
    return rows.withColumn("share", F.try_divide("matched", "entities"))
