"""From TSV sources to the two id lists: normalise, block, score, decide, assemble, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.operators import assemble, blocking, diagnostics, features, keys, labels, policy
from kinlink.operators.model import Matcher, plain_score
from kinlink.sources import io

MATCHING, CANDIDATES = "matching_results.tsv", "candidate_pairs.tsv"


@dataclass
class Sides:
    left: DataFrame
    right: DataFrame
    canonical: DataFrame


def sides(spark: SparkSession, root: str, split: str, cache: str | None = None) -> Sides:
    """S1, and S2 with S3, normalised; kept below `cache` if it is given."""
    sources = [io.read_source(spark, root, split, n) for n in (1, 2, 3)]
    tables = [io.cached_normalised(s, f"{cache}/{split}_source{n}") if cache else io.normalised(s) for n, s in enumerate(sources, 1)]
    return Sides(tables[0], tables[1].unionByName(tables[2]), sources[0].select("entity_id"))


def decided(scored: DataFrame, rules: dict, scope: str = "source") -> DataFrame:
    """The pairs that a saved policy keeps; without three thresholds in it, one flat threshold."""
    keep = rules["keep_threshold"]
    fallback = rules.get("fallback_top1_threshold", keep)
    if fallback >= keep:
        return policy.flat(scored, keep)
    return policy.three_threshold(scored, rules.get("singleton_cutoff", 0.0), keep, fallback, scope)


def infer(spark: SparkSession, root: str, split: str, out: str, model: str | None = None, rules: str | None = None, passes: list[str] | None = None, budget: int | None = keys.MAX_TOTAL_PAIRS) -> DataFrame:
    """Writes both lists below out, each as one TSV file with a row for every canonical entity, and gives their coverage.
    model: a saved Matcher; without one the plain scorer. rules: a saved policy; without one the flat default."""
    met = sides(spark, root, split, f"{out}/_normalised")
    pairs = blocking.multipass(met.left, met.right, keys.passes(passes), budget=budget, store=f"{out}/_keys")
    pairs.write.mode("overwrite").parquet(f"{out}/_candidates")
    pairs = spark.read.schema(pairs.schema).parquet(f"{out}/_candidates")
    if model:
        scored = Matcher.load(model).score(features.pair_features(pairs, met.left, met.right))
    else:
        scored = plain_score(features.native_features(pairs, met.left, met.right)).withColumn("src", F.col("entity_id_r").startswith("S3-").cast("int"))
    scored = scored.select("entity_id_l", "entity_id_r", "src", "prob")
    matches = assemble.id_lists(decided(scored, io.load_policy(spark, rules or f"{out}/_policy")), met.canonical)
    io.write_single(matches, f"{out}/{MATCHING}")
    io.write_single(assemble.id_lists(pairs, met.canonical, "candidate_entity_ids", resort=False), f"{out}/{CANDIDATES}")
    return assemble.coverage(io.read_tsv(spark, f"{out}/{MATCHING}", io.TRUTH).na.fill("", ["matched_entity_ids"]))


def blocking_report(spark: SparkSession, root: str, split: str, passes: list[str] | None = None, validation: bool = False) -> DataFrame:
    """(pass, hit, total, recall) of each pass among its kept keys, and of all; on the validation entities if so told."""
    met = sides(spark, root, split)
    truth = labels.ground_truth(io.read_ground_truth(spark, root, split))
    if validation:
        truth = truth.where(labels.is_validation(F.col("entity_id_l")) == 1)
    return diagnostics.recall_by_pass(met.left, met.right, truth, keys.passes(passes), suppressed=True)
