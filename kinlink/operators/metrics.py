"""Metrics of decisions: macro F-beta by two definitions, sweeps, grids, pair metrics, AUC and log-loss.

scored: (entity_id_l, entity_id_r, prob, label). A sweep is one aggregation: each entity's rows are counted at every
threshold at once, and the means over entities are taken in a second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))


def f_beta(p: Column, r: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * p * r, b * p + r), F.lit(0.0))


def entity_counts(scored: DataFrame, predicted: Column) -> DataFrame:
    """(entity_id_l, gt, pred, tp); gt is counted from the candidates' labels."""
    hit = predicted.cast("long")
    return scored.groupBy("entity_id_l").agg(F.sum(F.col("label").cast("long")).alias("gt"), F.sum(hit).alias("pred"), F.sum(hit * F.col("label")).alias("tp"))


def entity_f(counts: DataFrame, mode: str = "gt_only") -> DataFrame:
    """counts with p, r, f. gt_only: entities with gt > 0, an empty prediction has p = 0. all: every entity, where 0 / 0
    is 1, so a rightly empty one scores 1."""
    empty = F.lit(0.0 if mode == "gt_only" else 1.0)
    rows = counts.where("gt > 0") if mode == "gt_only" else counts
    rows = rows.withColumns({"p": F.when(F.col("pred") == 0, empty).otherwise(F.try_divide("tp", "pred")), "r": F.when(F.col("gt") == 0, empty).otherwise(F.try_divide("tp", "gt"))})
    return rows.withColumn("f", f_beta(F.col("p"), F.col("r")))


def macro_f(scored: DataFrame, predicted: Column, mode: str = "gt_only", entities: DataFrame | None = None, truth: DataFrame | None = None) -> DataFrame:
    """One row (entities, macro_f). In mode all, entities without candidates count too (entities: entity_id_l), and gt
    comes from the truth if there is one."""
    counts = entity_counts(scored, predicted)
    if truth is not None:
        gt = truth.groupBy("entity_id_l").agg(F.count(F.lit(1)).alias("gt"))
        counts = counts.drop("gt").join(gt, "entity_id_l", "full")
    if entities is not None:
        counts = entities.select("entity_id_l").distinct().join(counts, "entity_id_l", "left")
    return entity_f(counts.na.fill(0, ["gt", "pred", "tp"]), mode).agg(F.count(F.lit(1)).alias("entities"), F.avg("f").alias("macro_f"))


def _f(gt: Column, pred: Column, tp: Column, mode: str) -> Column:
    """The F of an entity as entity_f() has it; null for entities that the mode leaves out."""
    empty = F.lit(0.0 if mode == "gt_only" else 1.0)
    f = f_beta(F.when(pred == 0, empty).otherwise(F.try_divide(tp, pred)), F.when(gt == 0, empty).otherwise(F.try_divide(tp, gt)))
    return F.when(gt > 0, f) if mode == "gt_only" else f


def _reached(thresholds) -> list[Column]:
    """For each threshold i: n<i> rows that reach it, t<i> true ones among them."""
    hit = [(F.col("prob") >= float(t)) for t in thresholds]
    return [x for i, h in enumerate(hit) for x in (F.sum(h.cast("long")).alias(f"n{i}"), F.sum((h & (F.col("label") == 1)).cast("long")).alias(f"t{i}"))]


def sweep(scored: DataFrame, thresholds=GRID, mode: str = "gt_only") -> DataFrame:
    """(threshold, macro_f) over all thresholds: counts of each entity at each threshold in one aggregation, means in
    another; no row is repeated."""
    each = scored.groupBy("entity_id_l").agg(F.sum(F.col("label").cast("long")).alias("gt"), *_reached(thresholds))
    means = each.agg(*[F.avg(_f(F.col("gt"), F.col(f"n{i}"), F.col(f"t{i}"), mode)).alias(f"f{i}") for i in range(len(thresholds))])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"f{i}").alias("macro_f")) for i, t in enumerate(thresholds)])
    return means.select(F.explode(rows).alias("r")).select("r.*").where("macro_f is not null")


def best_threshold(swept: DataFrame) -> DataFrame:
    """The first threshold of the largest macro_f."""
    return swept.orderBy(F.desc("macro_f"), "threshold").limit(1)


def policy_grid(scored: DataFrame, singleton, keep, fallback) -> DataFrame:
    """(singleton, keep, fallback, macro_f) of the three-threshold policy with one best, for all combinations with
    singleton < fallback < keep. An entity's best, its label, and its counts at each `keep` suffice for every one. Below
    the fallback nothing is kept, so the first cut changes no mean and only pairs (keep, fallback) are worked out."""
    pairs = [(i, k, f) for i, k in enumerate(keep) for f in fallback if f < k]
    top = F.min_by(F.struct("prob", "label"), F.struct((-F.col("prob")).alias("p"), "entity_id_r"))
    best = scored.groupBy("entity_id_l").agg(F.sum(F.col("label").cast("long")).alias("gt"), top.alias("top"), *_reached(keep))
    means = []
    for n, (i, k, f) in enumerate(pairs):
        many, only = F.col("top.prob") >= float(k), F.col("top.prob") >= float(f)
        pred, tp = (F.when(many, F.col(c)).when(only, one).otherwise(0).cast("long") for c, one in ((f"n{i}", F.lit(1)), (f"t{i}", F.col("top.label"))))
        means.append(F.avg(_f(F.col("gt"), pred, tp, "gt_only")).alias(f"m{n}"))
    rows = [F.struct(F.lit(float(s)).alias("singleton"), F.lit(float(k)).alias("keep"), F.lit(float(f)).alias("fallback"), F.col(f"m{n}").alias("macro_f")) for n, (_, k, f) in enumerate(pairs) for s in singleton if s < f]
    return best.agg(*means).select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("macro_f is not null")


def neighbourhood(policy: tuple[float, float, float], step: float = 0.05) -> tuple[tuple, tuple, tuple]:
    """The three values around each threshold of a policy (singleton, keep, fallback)."""
    return tuple(tuple(round(v + d * step, 4) for d in (-1, 0, 1)) for v in policy)


def pair_prf(scored: DataFrame, threshold: float) -> DataFrame:
    hit = F.col("prob") >= threshold
    tp, pred, gt = F.sum((hit & (F.col("label") == 1)).cast("long")), F.sum(hit.cast("long")), F.sum(F.col("label").cast("long"))
    rows = scored.agg(tp.alias("tp"), pred.alias("pred"), gt.alias("gt"))
    rows = rows.withColumns({"precision": F.coalesce(F.try_divide("tp", "pred"), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", "gt"), F.lit(0.0))})
    return rows.withColumn("f", f_beta(F.col("precision"), F.col("recall")))


def singleton_accuracy(scored: DataFrame, threshold: float) -> DataFrame:
    """Entities without a true pair, and how many of them have no pair at or above the threshold."""
    each = scored.groupBy("entity_id_l").agg(F.sum(F.col("label").cast("long")).alias("gt"), F.max("prob").alias("best")).where("gt = 0")
    rows = each.agg(F.count(F.lit(1)).alias("singletons"), F.coalesce(F.sum((F.col("best") < threshold).cast("long")), F.lit(0)).alias("right"))
    return rows.withColumn("accuracy", F.try_divide("right", "singletons"))


def auc(scored: DataFrame) -> DataFrame:
    """Exact AUC with ties at their average rank: rows are counted by score, and only the scores are ranked."""
    by = scored.groupBy("prob").agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum((1 - F.col("label")).cast("long")).alias("n"))
    part = F.floor(F.least(F.col("prob"), F.lit(0.999999999)) * 1024)
    sums = by.groupBy(part.alias("b")).agg(F.sum("n").alias("m"))
    before = sums.select(F.col("b").alias("b2"), (F.sum("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("start"))  # at most 1,024 rows
    inner = Window.partitionBy("b").orderBy("prob").rowsBetween(Window.unboundedPreceding, 0)
    placed = by.withColumn("b", part).withColumn("below", F.sum("n").over(inner) - F.col("n")).join(before, F.col("b") == F.col("b2"))
    return placed.agg(F.try_divide(F.sum(F.col("p") * (F.col("start") + F.col("below") + F.col("n") / 2.0)), F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def log_loss(scored: DataFrame, eps: float = 1e-15) -> DataFrame:
    p = F.greatest(F.least(F.col("prob"), F.lit(1 - eps)), F.lit(eps))
    return scored.agg(F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))


def by_group(scored: DataFrame, predicted: Column, group: str) -> DataFrame:
    """Macro F of entities with a true pair, per value of a column that is one per entity."""
    hit = predicted.cast("long")
    counts = scored.groupBy(group, "entity_id_l").agg(F.sum(F.col("label").cast("long")).alias("gt"), F.sum(hit).alias("pred"), F.sum(hit * F.col("label")).alias("tp"))
    return entity_f(counts).groupBy(group).agg(F.count(F.lit(1)).alias("entities"), F.avg("f").alias("macro_f"))
