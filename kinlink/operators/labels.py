"""Ground truth, the split of entities into training and validation, and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.functions.text import split_bucket


def ground_truth(packed: DataFrame, source: int | None = None) -> DataFrame:
    """Distinct (entity_id_l, entity_id_r) of packed lists, of one source (2 or 3) if told. Empty items are dropped."""
    other = F.explode(F.split("matched_entity_ids", ","))
    pairs = packed.select(F.col("source1_entity_id").alias("entity_id_l"), other.alias("o")).select("entity_id_l", F.trim("o").alias("entity_id_r"))
    pairs = pairs.where("entity_id_r <> ''")
    if source is not None:
        pairs = pairs.where(F.col("entity_id_r").startswith(f"S{source}-"))
    return pairs.distinct()


def is_validation(entity_id: Column, tenths: int = 2) -> Column:
    """1 for the entities of the validation part: two tenths by MD5."""
    return (split_bucket(entity_id) < tenths).cast("int")


def entity_split(entities: DataFrame) -> DataFrame:
    return entities.select("entity_id").distinct().select("entity_id", is_validation(F.col("entity_id")).alias("isval"))


def leakage(train: DataFrame, validation: DataFrame) -> DataFrame:
    """Entities in both parts; a clean split has none."""
    return train.select("entity_id").intersect(validation.select("entity_id"))


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label: 1 if the pair is in the truth."""
    known = truth.select("entity_id_l", "entity_id_r").distinct().withColumn("__hit", F.lit(1))
    return pairs.join(known, ["entity_id_l", "entity_id_r"], "left").withColumn("label", F.coalesce("__hit", F.lit(0))).drop("__hit")


def balance(pairs: DataFrame, label: str = "label") -> DataFrame:
    """(pairs, positive, rate) of labelled pairs."""
    rows = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("positive"))
    return rows.withColumn("rate", F.coalesce(F.try_divide("positive", "pairs"), F.lit(0.0)))


def _unit(*columns: str, seed: int) -> Column:
    """A number in [0, 1) from MD5 of the columns and the seed; the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("~", *columns, F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def keep_negatives(pairs: DataFrame, one_in: int, seed: int = 42) -> DataFrame:
    """All pairs with label 1 and one in `one_in` of the others, by MD5 of the pair."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("~", "entity_id_l", "entity_id_r", F.lit(str(seed)))), 1, 8), 16, 10).cast("long") % one_in == 0
    return pairs.where((F.col("label") == 1) | drawn)


#: Rows up to which a sample is the head of a sort, which one task holds.
HEAD = 100_000


def sample_rows(df: DataFrame, n: int, *columns: str, seed: int = 42) -> DataFrame:
    """n rows by the smallest hash of the columns: reruns and repartitioning give the same ones. Of larger samples the rows
    are counted by slices of the hash: whole slices are taken, and only the last one's rows are sorted."""
    if n > HEAD:
        rows = df.withColumn("__u", _unit(*columns, seed=seed)).withColumn("__s", F.floor(F.col("__u") * (1 << 16)).cast("int"))
        before = 0
        for s, m in sorted(tuple(r) for r in rows.groupBy("__s").count().collect()):
            if before + m > n:
                last = rows.where(F.col("__s") == s).orderBy("__u", *columns).limit(n - before)
                return rows.where(F.col("__s") < s).unionByName(last).drop("__u", "__s")
            before += m
        return df
    return df.withColumn("__u", _unit(*columns, seed=seed)).orderBy("__u", *columns).limit(n).drop("__u")


def sample_fraction(df: DataFrame, share: float, *columns: str, seed: int = 42) -> DataFrame:
    """Rows whose columns' hash lies below share; rows of one entity stay together."""
    return df.where(_unit(*columns, seed=seed) < share)


def every_nth(df: DataFrame, n: int, *order: str, per: str | None = None) -> DataFrame:
    """Every n-th row by an explicit order, within each `per` (or hash slices of the first column, so that no window
    spans the table)."""
    part = F.col(per) if per else F.pmod(F.xxhash64(order[0]), F.lit(4096))
    w = Window.partitionBy(part).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") % n == 1 % n).drop("__n")


def stratified_split(df: DataFrame, share: float, *columns: str, label: str = "label", seed: int = 42) -> DataFrame:
    """df with isval: a row-level split that draws `share` of each label. It lets an entity fall into both parts."""
    return df.withColumn("isval", (_unit(label, *columns, seed=seed) < share).cast("int"))


def balanced(df: DataFrame, per_label: int, *columns: str, label: str = "label", seed: int = 42) -> DataFrame:
    """Up to per_label rows of each of labels 0 and 1."""
    return sample_rows(df.where(F.col(label) == 1), per_label, *columns, seed=seed).unionByName(sample_rows(df.where(F.col(label) == 0), per_label, *columns, seed=seed))


def matched_and_fill(df: DataFrame, matched: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All rows of df whose entity_id is in matched, filled up with others to n rows."""
    hit = df.join(matched.select("entity_id").distinct(), "entity_id", "left_semi")
    rest = df.join(matched.select("entity_id").distinct(), "entity_id", "left_anti")
    return hit.unionByName(sample_rows(rest, max(0, n - hit.count()), "entity_id", seed=seed))


def random_pairs(left: DataFrame, right: DataFrame, n: int = 1_000_000, seed: int = 42) -> DataFrame:
    """About n distinct pairs drawn from all, true ones too. Each id draws slots by MD5 until its side has n, and the
    sides are joined by slot: nothing is crossed, and reruns and other engines give the same pairs."""
    def slots(side: DataFrame, name: str) -> DataFrame:
        ids = side.select(F.col("entity_id").alias(name)).distinct()
        rounds = -(-n // max(1, ids.count()))
        many = ids.select(name, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r"))
        return many.select(name, (F.conv(F.substring(F.md5(F.concat_ws("~", name, F.col("r").cast("string"), F.lit(f"{seed}{name[-1]}"))), 1, 8), 16, 10).cast("long") % n).alias("slot"))

    return slots(left, "entity_id_l").join(slots(right, "entity_id_r"), "slot").select("entity_id_l", "entity_id_r").distinct()


def random_negatives(left: DataFrame, right: DataFrame, truth: DataFrame, per_positive: int = 3, seed: int = 42) -> DataFrame:
    """About per_positive pairs for each true one, both ends drawn by hash, none of them true. Each draw takes a slot of
    each side, so the join is one to one and nothing is crossed."""
    n = truth.count() * per_positive
    spare = n + n // 5 + 10  # a few draws fall on true or equal pairs

    def slots(side: DataFrame, name: str, s: int) -> DataFrame:
        ids = side.select(F.col("entity_id").alias(name)).distinct()
        rounds = -(-spare // max(1, ids.count()))
        many = ids.select(name, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r"))
        slot = F.pmod(F.xxhash64(name, "r", F.lit(s)), F.lit(spare))
        return many.select(name, slot.alias("slot"))

    drawn = slots(left, "entity_id_l", seed).join(slots(right, "entity_id_r", seed + 1).hint("merge"), "slot").select("entity_id_l", "entity_id_r").distinct()  # the planner knows the ids' size, not the draws'
    clean = drawn.join(truth.select("entity_id_l", "entity_id_r").hint("merge"), ["entity_id_l", "entity_id_r"], "left_anti")
    return sample_rows(clean, n, "entity_id_l", "entity_id_r", seed=seed)
