"""The thirteen features of a candidate pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.functions import similarity as S
from kinlink.functions import text
from kinlink.operators.labels import labelled

NATIVE = ["tok_jaccard", "country_match", "name_len_diff", "fsig_match", "lev_name", "addr_house_match", "addr_pin_match", "addr_street_jaccard"]
JARO = ["jw_name", "jw_addr", "jaro_name", "jaro_addr"]
FEATURES = [*JARO[:2], "tok_jaccard", "country_match", "name_len_diff", "fsig_match", "lev_name", *JARO[2:], "addr_house_match", "addr_pin_match", "addr_street_jaccard", "src"]
LEGACY = ["jw_name", "jw_addr", "tok_jaccard", "country_match", "name_len_diff", "fsig_match", "src"]


def side_table(norm: DataFrame, suffix: str) -> DataFrame:
    """A normalised table with what the features need of one side, computed once per record and not per pair."""
    name, addr = F.coalesce("name_norm", F.lit("")), F.coalesce("addr_norm", F.lit(""))
    tokens = F.coalesce("name_tokens", F.array().cast("array<string>"))
    out = norm.select(
        "entity_id", name.alias("name"), addr.alias("addr"), tokens.alias("tokens"), F.col("country_norm").alias("country"), text.first_significant(tokens).alias("fsig"),
        F.length(name).cast("long").alias("nlen"), text.house_number(addr).alias("house"), text.postal_code(addr).alias("pin"), text.street_words(addr).alias("street"),
    )
    return out.toDF(*[f"{c}{suffix}" for c in out.columns])


def native_features(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs with both sides' columns and the features that need no Python. Pairs of unknown ids are dropped."""
    met = pairs.join(side_table(left, "_l"), "entity_id_l").join(side_table(right, "_r"), "entity_id_r")
    c = F.col

    def same(a: str) -> F.Column:
        return ((c(f"{a}_l") == c(f"{a}_r")) & (c(f"{a}_l") != "")).cast("int")

    return met.withColumns({
        "tok_jaccard": S.jaccard(c("tokens_l"), c("tokens_r")), "country_match": (c("country_l") == c("country_r")).cast("int"), "name_len_diff": F.abs(c("nlen_l") - c("nlen_r")),
        "fsig_match": (c("fsig_l") == c("fsig_r")).cast("int"), "lev_name": S.lev_sim(c("name_l"), c("name_r")), "addr_house_match": same("house"), "addr_pin_match": same("pin"), "addr_street_jaccard": S.jaccard(c("street_l"), c("street_r")),
    })


def pair_features(pairs: DataFrame, left: DataFrame, right: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """(entity_id_l, entity_id_r) -> ids, the features and, with a truth, label. src is 1 for ids of S3, else 0. Jaro is
    computed once per string pair and Jaro-Winkler comes from it."""
    met = native_features(pairs.select("entity_id_l", "entity_id_r"), left, right)
    jaro = met.withColumns({"jaro_name": S.jaro(F.col("name_l"), F.col("name_r")), "jaro_addr": S.jaro(F.col("addr_l"), F.col("addr_r"))})
    full = jaro.withColumns({"jw_name": S.jaro_winkler(F.col("name_l"), F.col("name_r"), F.col("jaro_name")), "jw_addr": S.jaro_winkler(F.col("addr_l"), F.col("addr_r"), F.col("jaro_addr")), "src": F.col("entity_id_r").startswith("S3-").cast("int")})
    out = full.select("entity_id_l", "entity_id_r", *FEATURES)
    return out if truth is None else labelled(out, truth)


NAME = ["jw_name", "tok_jaccard", "name_len_diff", "fsig_match", "lev_name", "jaro_name"]
ADDRESS = ["jw_addr", "jaro_addr", "addr_house_match", "addr_pin_match", "addr_street_jaccard"]


def features_by_part(pairs: DataFrame, left: DataFrame, right: DataFrame, folder: str) -> DataFrame:
    """What pair_features gives without a truth, each pair of names and each pair of addresses worked out once: a side's
    first record of a name, or of an address, stands for all that have it. Tables in between are written below folder."""
    spark = pairs.sparkSession

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    def named(side: DataFrame, s: str) -> DataFrame:
        rows = side.select(F.col("entity_id").alias(f"entity_id_{s}"), F.coalesce("name_norm", F.lit("")).alias("name"), F.coalesce("addr_norm", F.lit("")).alias("addr"), F.col("country_norm").alias(f"country_{s}"))
        for part in ("name", "addr"):
            first = rows.groupBy(part).agg(F.min(f"entity_id_{s}").alias(f"{part}_{s}"))
            rows = rows.join(first.hint("merge"), part).drop(part)
        return rows

    met = stored(pairs.join(named(left, "l"), "entity_id_l").join(named(right, "r"), "entity_id_r"), "met")
    for part, columns in (("name", NAME), ("addr", ADDRESS)):
        ids = [f"{part}_l", f"{part}_r"]
        once = met.select(*ids).distinct().toDF("entity_id_l", "entity_id_r")
        known = stored(pair_features(once, left, right).select("entity_id_l", "entity_id_r", *columns), part)
        met = met.join(known.toDF(*ids, *columns), ids)
    out = met.withColumns({"country_match": (F.col("country_l") == F.col("country_r")).cast("int"), "src": F.col("entity_id_r").startswith("S3-").cast("int")})
    return out.select("entity_id_l", "entity_id_r", *FEATURES)


def training_set(pairs: DataFrame, left: DataFrame, right: DataFrame, truth: DataFrame, part: str = "train", one_in: int = 10) -> DataFrame:
    """Features of the pairs of one part of the entity split: train (all true pairs, one in one_in of the others),
    validation (all pairs) or all."""
    from kinlink.operators.labels import is_validation, keep_negatives

    if part != "all":
        pairs = pairs.where(is_validation(F.col("entity_id_l")) == int(part == "validation"))
    marked = labelled(pairs, truth)
    if part == "train":
        marked = keep_negatives(marked, one_in)
    return pair_features(marked, left, right, truth)
