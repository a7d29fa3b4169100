"""What blocking reaches and costs: recall against the truth, projected pairs, candidates per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.operators import keys as K
from kinlink.operators.blocking import BUCKETS, HEAD_CAP, counts, kept_keys, rank_cap

IDS = ["entity_id_l", "entity_id_r"]


def pair_recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(hit, total, recall) of the true pairs among the candidates."""
    return _recall(_hits(candidates, truth))


def _hits(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    found = candidates.select(*IDS).distinct().withColumn("__hit", F.lit(1))
    return truth.select(*IDS).distinct().join(found, IDS, "left").select(*IDS, F.coalesce("__hit", F.lit(0)).alias("hit"))


def _recall(hits: DataFrame, *by: str) -> DataFrame:
    rows = hits.groupBy(*by).agg(F.coalesce(F.sum("hit").cast("long"), F.lit(0)).alias("hit"), F.count(F.lit(1)).alias("total"))
    return rows.withColumn("recall", F.coalesce(F.try_divide("hit", "total"), F.lit(0.0)))


def recall_by_country(candidates: DataFrame, truth: DataFrame, left: DataFrame) -> DataFrame:
    country = left.select(F.col("entity_id").alias("entity_id_l"), "country_norm")
    return _recall(_hits(candidates, truth).join(country, "entity_id_l", "left"), "country_norm")


def _true_hits(lk: DataFrame, rk: DataFrame, truth: DataFrame) -> DataFrame:
    """Distinct (pass, ids) of true pairs whose ends share a key: the truth is met with one side's keys, then the other's,
    so no pairs but true ones are made."""
    l = lk.select("pass", "key", F.col("entity_id").alias("entity_id_l")).distinct()  # noqa: E741
    r = rk.select("pass", "key", F.col("entity_id").alias("entity_id_r")).distinct()
    return truth.select(*IDS).distinct().join(l, "entity_id_l").join(r, ["entity_id_r", "pass", "key"]).select("pass", *IDS).distinct()


def _shared_keys(lk: DataFrame, rk: DataFrame, truth: DataFrame) -> DataFrame:
    """(l, r, n, shared): n distinct true pairs, whose ends have the keys of l and of r, and the (pass, key) in both.
    Records of equal keys are one row. Joins are told not to broadcast: a table of keys is far larger than the file that
    it comes from, which is all that the planner knows of it."""
    def side(keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        own = keys.groupBy("entity_id").agg(F.array_sort(F.collect_set(F.struct("pass", "key"))).alias("ks"))
        sets = own.groupBy("ks").agg(F.min("entity_id").alias(name))
        return own.join(sets.hint("merge"), "ks").select(F.col("entity_id").alias(f"entity_id_{name}"), name), sets.withColumnRenamed("ks", f"ks_{name}")

    (l, l_sets), (r, r_sets) = side(lk, "l"), side(rk, "r")
    pairs = truth.select(*IDS).distinct().join(l.hint("merge"), "entity_id_l").join(r.hint("merge"), "entity_id_r").groupBy("l", "r").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(l_sets.hint("merge"), "l").join(r_sets.hint("merge"), "r").select("l", "r", "n", F.array_intersect("ks_l", "ks_r").alias("shared"))


def recall_by_pass(left: DataFrame, right: DataFrame, truth: DataFrame, passes: list[K.Pass], suppressed: bool = False) -> DataFrame:
    """(pass, hit, total, recall) for each pass, before suppression or among the kept keys; a last row, any, for all."""
    lk, rk = K.long_keys(left, passes), K.long_keys(right, passes)
    if suppressed:
        kept = kept_keys(lk, rk, passes).select("pass", "key")
        lk, rk = lk.join(kept, ["pass", "key"], "left_semi"), rk.join(kept, ["pass", "key"], "left_semi")
    met = _shared_keys(lk, rk, truth).where(F.size("shared") > 0)
    hits = met.select("n", F.explode(F.array_union(F.transform("shared", lambda x: x["pass"]), F.array(F.lit("any")))).alias("pass"))
    total = truth.select(*IDS).distinct().count()
    names = truth.sparkSession.createDataFrame([(p.name,) for p in passes] + [("any",)], "pass string")
    rows = names.join(hits.groupBy("pass").agg(F.sum("n").alias("hit")), "pass", "left").na.fill(0, ["hit"])
    return rows.withColumns({"total": F.lit(total).cast("long"), "recall": F.lit(0.0) if not total else F.col("hit") / F.lit(total)})


def recall_with_interval(left: DataFrame, right: DataFrame, sample: DataFrame, schemes: dict) -> DataFrame:
    """(pass, hit, total, percent, plus_minus) of sampled true pairs by scheme, uncapped, with the 95 % interval."""
    passes = [K.Pass(n, f) for n, f in schemes.items()]
    p = F.col("hit") / F.col("total")
    rows = recall_by_pass(left, right, sample, passes)
    return rows.select("pass", "hit", "total", F.round(100 * p, 2).alias("percent"), F.round(100 * 1.96 * F.sqrt(p * (1 - p) / F.col("total")), 2).alias("plus_minus"))


def pair_estimates(left: DataFrame, right: DataFrame, schemes: dict, caps=(300, 100, 50), union: bool = True) -> DataFrame:
    """(pass, cap, min_cap, drop_cap): projected pairs with each side's key held to cap rows, and with keys over cap on a
    side dropped; cap 0 is uncapped. The pass union has every record once for each of its distinct keys."""
    lk, rk = K.long_keys(left, schemes), K.long_keys(right, schemes)
    if union:
        once = lambda k: k.unionByName(k.select("entity_id", F.lit("union").alias("pass"), F.concat("pass", F.lit(":"), "key").alias("key")).distinct())
        lk, rk = once(lk), once(rk)
    both = counts(lk, "n1").join(counts(rk, "n2"), ["pass", "key"])
    rows = both.withColumn("cap", F.explode(F.array(*[F.lit(c).cast("long") for c in (0, *caps)])))
    cap = F.when(F.col("cap") > 0, F.col("cap")).otherwise(F.lit(1 << 40))
    kept = (F.col("n1") <= cap) & (F.col("n2") <= cap)
    return rows.groupBy("pass", "cap").agg(
        F.sum(F.least("n1", cap) * F.least("n2", cap)).cast("long").alias("min_cap"), F.coalesce(F.sum(F.when(kept, F.col("n1") * F.col("n2"))), F.lit(0)).cast("long").alias("drop_cap")
    )


def capped_recall(left: DataFrame, right: DataFrame, truth: DataFrame, schemes: dict, caps=(50, 100, 300)) -> DataFrame:
    """(pass, cap, pairs, hit, total, recall) of each scheme, and of all together as `any`, when keys with more than cap
    rows on a side are dropped: projected pairs (for `any` the sum), and true pairs that share a key that stays. A true
    pair counts from the smallest cap on that one of its keys passes, so no pairs but true ones are made."""
    lk, rk = K.long_keys(left, schemes), K.long_keys(right, schemes)
    sized = counts(lk, "n1").join(counts(rk, "n2").hint("merge"), ["pass", "key"]).withColumn("larger", F.greatest("n1", "n2"))
    true = truth.select(*IDS).distinct()
    met = _shared_keys(lk, rk, true).select("l", "r", "n", F.explode("shared").alias("k")).select("l", "r", "n", "k.pass", "k.key").join(sized.hint("merge"), ["pass", "key"])
    least = met.groupBy("pass", "l", "r", "n").agg(F.min("larger").alias("larger"))
    least = least.unionByName(least.groupBy("l", "r", "n").agg(F.min("larger").alias("larger")).withColumn("pass", F.lit("any")))
    at = [F.lit(c).cast("long") for c in caps]
    hits = least.select("pass", "n", F.explode(F.filter(F.array(*at), lambda c: F.col("larger") <= c)).alias("cap")).groupBy("pass", "cap").agg(F.sum("n").alias("hit"))
    kept = sized.select("pass", "n1", "n2", F.explode(F.filter(F.array(*at), lambda c: F.col("larger") <= c)).alias("cap"))
    pairs = kept.groupBy("pass", "cap").agg(F.sum(F.col("n1") * F.col("n2")).alias("pairs"))
    pairs = pairs.unionByName(pairs.groupBy("cap").agg(F.sum("pairs").alias("pairs")).withColumn("pass", F.lit("any")))
    every = true.sparkSession.createDataFrame([(n, c) for n in (*schemes, "any") for c in caps], "pass string, cap long")
    rows = every.join(pairs, ["pass", "cap"], "left").join(hits, ["pass", "cap"], "left").na.fill(0, ["pairs", "hit"])
    return rows.withColumn("total", F.lit(true.count()).cast("long")).withColumn("recall", F.coalesce(F.try_divide("hit", "total"), F.lit(0.0)))


def bucket_recall(left: DataFrame, right: DataFrame, truth: DataFrame, cap: int = HEAD_CAP) -> DataFrame:
    """(hit, total, recall) of the true pairs whose ends are both among the first cap rows of one phonetic bucket."""
    lk, rk = (rank_cap(K.long_keys(s, BUCKETS), cap) for s in (left, right))
    return _recall(_hits(_true_hits(lk, rk, truth), truth))


def candidate_stats(candidates: DataFrame, entities: DataFrame, n_right: int) -> DataFrame:
    """One row over all entities, those without candidates counted as 0: mean, median, p90 (the element at
    round((n - 1) * 0.9) of the sorted counts), max, entities without any, and the reduction ratio in full precision."""
    n = candidates.groupBy(F.col("entity_id_l").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
    each = entities.select("entity_id").distinct().join(n, "entity_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    # few distinct counts: their running totals replace a sort of all entities
    by = each.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    table = by.agg(F.array_sort(F.collect_list(F.struct("n", "m"))).alias("t"), F.sum("m").alias("entities"), F.sum(F.col("n") * F.col("m")).alias("pairs"), F.max("n").alias("max"), F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("m"))), F.lit(0)).alias("zero"))

    def at(place):  # the element at a place of the sorted counts
        step = lambda acc, x: F.struct((acc["seen"] + x["m"]).alias("seen"), F.when((acc["seen"] <= place) & (place < acc["seen"] + x["m"]), x["n"]).otherwise(acc["got"]).alias("got"))
        return F.aggregate("t", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("got")), step, lambda acc: acc["got"])

    last = F.col("entities") - 1
    middle = (at(F.floor(last / 2.0)) + at(F.ceil(last / 2.0))) / 2.0
    return table.select("entities", "pairs", (F.col("pairs") / F.col("entities")).alias("mean"), middle.alias("median"), at(F.floor(last * 0.9 + 0.5)).alias("p90"), "max", "zero", (1 - F.col("pairs") / (F.col("entities") * F.lit(float(max(1, n_right))))).alias("reduction"))
