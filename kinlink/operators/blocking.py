"""Candidate pairs from keys that two sides share, with frequent keys suppressed.

Three ways to hold frequent keys down: drop the key, keep its first rows by id, or drop it if its product is too large.
Counting comes before pairing, and the projected number of pairs is known before any pair is made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.operators import keys as K


#: Rows a key and side: dropped beyond, the first by id, and the first by id of soundex buckets.
DROP_CAP, RANK_CAP, HEAD_CAP = 300, 300, 50
#: Pairs that the older schemes may make.
PAIR_BUDGET = 100_000_000
#: Parts at most that rows of equal keys, and the pairs of a key, are dealt into; rows and pairs beyond which they are.
PARTS, LIST, TILE = 32, 1024, 1 << 22
#: Tasks a core that pairs of lists are dealt to.
WAVES = 16


class BudgetExceeded(RuntimeError):
    pass


def counts(keys: DataFrame, name: str) -> DataFrame:
    """Rows (not entities) per pass and key."""
    return keys.groupBy("pass", "key").agg(F.count(F.lit(1)).alias(name))


def shared_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pass, key, n1, n2) of keys on both sides."""
    return counts(left, "n1").join(counts(right, "n2"), ["pass", "key"])


def limits(passes: list[K.Pass]) -> tuple:
    """Columns max_freq and max_pairs of the pass of a row."""
    freq, pairs = F.lit(None).cast("long"), F.lit(None).cast("long")
    for p in passes:
        freq = F.when(F.col("pass") == p.name, F.lit(p.max_freq)).otherwise(freq)
        pairs = F.when(F.col("pass") == p.name, F.lit(p.max_pairs)).otherwise(pairs)
    return freq, pairs


def kept_keys(left: DataFrame, right: DataFrame, passes: list[K.Pass]) -> DataFrame:
    """Shared keys within their pass's limits of frequency on each side and of product."""
    freq, pairs = limits(passes)
    both = shared_keys(left, right)
    return both.where((F.col("n1") <= freq) & (F.col("n2") <= freq) & (F.col("n1") * F.col("n2") <= pairs))


def pass_stats(left: DataFrame, right: DataFrame, passes: list[K.Pass]) -> DataFrame:
    """For each pass: keys on each side, dropped by frequency on each side, shared, dropped by product, kept, and the
    projected pairs. A pass that both sides have no key for has no row."""
    freq, pairs = limits(passes)
    one, two = counts(left, "n1"), counts(right, "n2")
    both = one.join(two, ["pass", "key"], "full").withColumns({"f": freq, "p": pairs})
    n1, n2 = F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))
    shared = (n1 > 0) & (n2 > 0)
    calm = shared & (n1 <= F.col("f")) & (n2 <= F.col("f"))
    keep = calm & (n1 * n2 <= F.col("p"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return both.groupBy("pass").agg(
        n(n1 > 0).alias("keys_l"), n(n2 > 0).alias("keys_r"), n(n1 > F.col("f")).alias("freq_dropped_l"), n(n2 > F.col("f")).alias("freq_dropped_r"), n(shared).alias("shared"),
        n(calm & ~keep).alias("product_dropped"), n(keep).alias("kept"), F.coalesce(F.sum(F.when(keep, n1 * n2)), F.lit(0)).cast("long").alias("pairs"),
    )


def pair_up(left: DataFrame, right: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Distinct (entity_id_l, entity_id_r) of rows that share a pass and key, of the kept keys if given."""
    on = ["pass", "key"]
    if kept is not None:
        kept = kept.select(*on)
        left, right = left.join(kept, on, "left_semi"), right.join(kept, on, "left_semi")
    l = left.select("pass", "key", F.col("entity_id").alias("entity_id_l"))  # noqa: E741
    r = right.select("pass", "key", F.col("entity_id").alias("entity_id_r"))
    return l.join(r, on).where("entity_id_l <> entity_id_r").select("entity_id_l", "entity_id_r").distinct()


def met(left: DataFrame, right: DataFrame) -> DataFrame:
    """(entity_id_l, entity_id_r) of the rows (entity_id, ks: array of keys, sorted) that share a key, each pair of rows
    once. Rows of equal ks go together as lists of ids, and a list meets another at the first key that both have, so no
    pair is shuffled or compared with another. Keys of many pairs are dealt to several tasks, and the lists that meet are
    dealt out again: a few bytes of them make many pairs, so their size doesn't say how many tasks it takes."""
    def packed(side: DataFrame) -> DataFrame:
        lists = side.where(F.size("ks") > 0).groupBy("ks", F.pmod(F.xxhash64("entity_id"), F.lit(PARTS)).alias("part")).agg(F.collect_list("entity_id").alias("ids"))
        n = lists.groupBy("ks").agg(F.sum(F.size("ids").cast("long")).alias("n"))
        wanted = F.least(F.ceil(F.col("n") / LIST), F.lit(PARTS))  # short lists are put together
        lists = lists.join(n, "ks").groupBy("ks", F.pmod("part", wanted).alias("part")).agg(F.flatten(F.collect_list("ids")).alias("ids"))
        return lists.select("ks", F.xxhash64("ks", "part").alias("part"), "ids", F.explode("ks").alias("k"))

    l, r = packed(left), packed(right)  # noqa: E741
    rows = lambda d, n: d.groupBy("k").agg(F.sum(F.size("ids").cast("double")).alias(n))
    dealt = rows(l, "n1").join(rows(r, "n2"), "k").select("k", F.least(F.ceil(F.col("n1") * F.col("n2") / TILE), F.lit(PARTS)).cast("int").alias("parts"))
    l = l.join(dealt, "k").select("k", F.col("ks").alias("ks_l"), F.col("ids").alias("ids_l"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))  # noqa: E741
    r = r.join(dealt, "k").select("k", F.col("ks").alias("ks_r"), F.col("ids").alias("ids_r"), F.pmod("part", "parts").alias("part"))
    both = l.join(r, ["k", "part"]).where(F.array_min(F.array_intersect("ks_l", "ks_r")) == F.col("k"))
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), WAVES * spark.sparkContext.defaultParallelism)
    both = both.select("ids_l", "ids_r").repartition(tasks, F.xxhash64(F.get("ids_l", F.lit(0)), F.get("ids_r", F.lit(0))))
    each = F.transform("ids_l", lambda x: x)  # not compiled, so rows of this explode are made one by one: else all pairs of two lists are held at once
    return both.select(F.explode(each).alias("entity_id_l"), "ids_r").select("entity_id_l", F.explode("ids_r").alias("entity_id_r"))


def within(shared: DataFrame, budget: int | None) -> None:
    """Raises if the pairs projected from keys (n1, n2 rows on the sides) exceed the budget; none are made for it."""
    if budget is not None:
        projected = shared.agg(F.sum(F.col("n1") * F.col("n2"))).head()[0] or 0
        if projected > budget:
            raise BudgetExceeded(f"{projected} pairs projected; the budget is {budget}")


def multipass(left: DataFrame, right: DataFrame, passes: list[K.Pass], only_left: DataFrame | None = None, budget: int | None = None, store: str | None = None, finer: bool = False) -> DataFrame:
    """Candidates of all passes (finer: and of those that keys.refined adds): two normalised tables -> distinct pairs. Suppression looks at whole sides; only_left
    (entity_id) then restricts the left one. A budget is held against the projected pairs before any are made. Keys are
    read twice, to be counted and to be met: with `store` they are written there first, and not worked out again."""
    lk, rk = K.long_keys(left, passes, finer), K.long_keys(right, passes, finer)
    passes = K.refined(passes) if finer else passes
    if store:
        for name, rows in (("left", lk), ("right", rk)):
            rows.write.mode("overwrite").parquet(f"{store}/{name}")
        lk, rk = (left.sparkSession.read.schema(lk.schema).parquet(f"{store}/{name}") for name in ("left", "right"))
    kept = kept_keys(lk, rk, passes)
    within(kept, budget)
    if only_left is not None:
        lk = lk.join(only_left.select("entity_id"), "entity_id", "left_semi")
    return pair_up(lk, rk, kept)


def classes(norm: DataFrame) -> DataFrame:
    """(entity_id, class_id, record_id): rows of a side (S1, or the others) that are alike in all that keys read are a record,
    those of one source among them a class; both are named by their smallest id. Pairs of rows of the same classes have
    equal keys and features, so blocking need only meet records and features only classes."""
    alike = ["first", "name_norm", "addr_norm", "country_norm"]
    rows = norm.select("entity_id", F.split("entity_id", "-")[0].alias("source"), F.col("entity_id").startswith("S1-").alias("first"), *alike[1:])
    one = rows.groupBy("source", *alike).agg(F.min("entity_id").alias("class_id"))
    whole = one.groupBy(*alike).agg(F.min("class_id").alias("record_id"))
    apart = lambda d, s: d.toDF(*[f"{c}{s}" for c in d.columns])
    same = lambda on, s: [F.col(c).eqNullSafe(F.col(f"{c}{s}")) for c in on]
    named = one.join(apart(whole, "__w").hint("merge"), same(alike, "__w")).select("source", *alike, "class_id", F.col("record_id__w").alias("record_id"))
    return rows.join(apart(named, "__n").hint("merge"), same(["source", *alike], "__n")).select("entity_id", F.col("class_id__n").alias("class_id"), F.col("record_id__n").alias("record_id"))


def class_labels(pairs: DataFrame, left: DataFrame, right: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs of classes, with label and pairs: for how many pairs of their members' rows they stand, one row for the true
    ones and one for the others. left, right: what classes() gives for the sides."""
    ids = ["entity_id_l", "entity_id_r"]
    named = lambda d, s: d.select(F.col("entity_id").alias(f"entity_id_{s}"), F.col("class_id").alias(f"class_{s}")).hint("merge")
    true = truth.select(*ids).distinct().join(named(left, "l"), ids[0]).join(named(right, "r"), ids[1])
    true = true.groupBy(F.col("class_l").alias(ids[0]), F.col("class_r").alias(ids[1])).agg(F.count(F.lit(1)).alias("__true"))
    size = lambda d, s: d.groupBy(F.col("class_id").alias(f"entity_id_{s}")).agg(F.count(F.lit(1)).alias(f"__{s}"))
    met = pairs.join(size(left, "l"), ids[0]).join(size(right, "r"), ids[1]).join(true, ids, "left").withColumn("__true", F.coalesce("__true", F.lit(0)))
    both = F.array(*[F.struct(F.lit(v).alias("label"), n.alias("pairs")) for v, n in ((1, F.col("__true")), (0, F.col("__l") * F.col("__r") - F.col("__true")))])
    return met.withColumn("__b", F.explode(both)).select(*pairs.columns, "__b.label", "__b.pairs").where("pairs > 0")


def drop_cap(keys: DataFrame, cap: int = DROP_CAP) -> DataFrame:
    """Keys with more than cap rows on this side are gone."""
    return keys.join(counts(keys, "n").where(F.col("n") <= cap).select("pass", "key"), ["pass", "key"], "left_semi")


def rank_cap(keys: DataFrame, cap: int = RANK_CAP) -> DataFrame:
    """The first cap rows of each key by id. The rank filter is pushed below the shuffle."""
    first = Window.partitionBy("pass", "key").orderBy("entity_id")
    return keys.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= cap).drop("__n")


def candidates(left: DataFrame, right: DataFrame, schemes: dict, cap: int | None = None, mode: str = "drop", budget: int | None = None) -> DataFrame:
    """Candidates by older schemes with one cap for each side: mode "drop" or "rank". Without a cap the named default of
    the mode holds, for BUCKETS that of buckets. A budget is held against the projected pairs of the capped keys."""
    if cap is None:
        cap = DROP_CAP if mode == "drop" else HEAD_CAP if schemes is BUCKETS else RANK_CAP
    held = {"drop": drop_cap, "rank": rank_cap}[mode]
    l, r = held(K.long_keys(left, schemes), cap), held(K.long_keys(right, schemes), cap)  # noqa: E741
    if budget is not None:
        within(shared_keys(l, r), budget)
    return pair_up(l, r)


THREE_KEYS = {"blk_a": K.positional, "blk_b1": lambda: K.phonetic_at(0), "blk_b2": lambda: K.phonetic_at(1)}
SIGNIFICANT = {"ct2f": K.significant_two}
BUCKETS = {"sdx": K.soundex_bucket}


def rare_overlap(left: DataFrame, right: DataFrame, share: float, budget: int | None = None) -> DataFrame:
    """Pairs of one country that share a name token which is rare on both sides: in at most `share` of each one's rows. A
    budget is held against the projected pairs."""
    def side(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        whole = df.count()
        t = df.select("entity_id", "country_norm", F.explode(F.array_distinct("name_tokens")).alias("token"))
        many = t.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > whole * share)
        return t, many.select("token")

    (lt, lm), (rt, rm) = side(left), side(right)
    frequent = lm.union(rm).distinct()
    l = lt.join(frequent, "token", "left_anti").select("token", "country_norm", F.col("entity_id").alias("entity_id_l"))  # noqa: E741
    r = rt.join(frequent, "token", "left_anti").select("token", "country_norm", F.col("entity_id").alias("entity_id_r"))
    on = ["token", "country_norm"]
    if budget is not None:
        within(l.groupBy(*on).agg(F.count(F.lit(1)).alias("n1")).join(r.groupBy(*on).agg(F.count(F.lit(1)).alias("n2")), on), budget)
    own = lambda d, s: d.where("token is not null and country_norm is not null").groupBy(F.col(f"entity_id_{s}").alias("entity_id")).agg(F.array_sort(F.collect_set(F.struct(*on))).alias("ks"))
    return met(own(l, "l"), own(r, "r"))


def union_candidates(*pairs: DataFrame) -> DataFrame:
    """Distinct pairs of several generators (keys, neighbours, rules)."""
    out = pairs[0].select("entity_id_l", "entity_id_r")
    for p in pairs[1:]:
        out = out.unionByName(p.select("entity_id_l", "entity_id_r"))
    return out.distinct()
