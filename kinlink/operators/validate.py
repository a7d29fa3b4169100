"""Checks of written id lists. Findings come as rows (rule, severity, count, examples); no rows mean a clean file."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MATCHES = ("source1_entity_id", "matched_entity_ids")
CANDIDATES = ("source1_entity_id", "candidate_entity_ids")
EXAMPLES = 5


def findings(offenders: DataFrame, severity: str = "error") -> DataFrame:
    """Offenders (rule, id) -> a row for each rule with their number and the first examples in order. The examples are
    taken by a top-k of each partition, never from a list of all."""
    ids = offenders.distinct()
    first = F.row_number().over(Window.partitionBy("rule").orderBy("id"))
    few = ids.withColumn("n", first).where(F.col("n") <= EXAMPLES).groupBy("rule").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    n = ids.groupBy("rule").agg(F.count(F.lit(1)).alias("count"))
    return n.join(few, "rule").select("rule", F.lit(severity).alias("severity"), "count", "examples")


def _items(column: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def check_lists(rows: DataFrame, column: str, required: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Rules on rows (source1_entity_id, column): an entity twice, an id twice in a list, an S1 id, a wrong prefix, an id
    not in known (entity_id), a required entity missing, an entity that isn't required."""
    lists = rows.select(F.trim("source1_entity_id").alias("id"), _items(column).alias("ids"))
    bad = lambda x: ~x.startswith("S1-") & ~x.startswith("S2-") & ~x.startswith("S3-")
    own = {"duplicate_id": F.size(F.array_distinct("ids")) < F.size("ids"), "self_match": F.exists("ids", lambda x: x.startswith("S1-")), "bad_prefix": F.exists("ids", bad)}
    seen, of_all = lists.groupBy("id").agg(F.count(F.lit(1)).alias("n")), {"duplicate_row": F.col("n") > 1}
    if required is not None:
        need = required.select(F.col("entity_id").alias("id")).distinct().withColumn("need", F.lit(1))
        seen = seen.join(need, "id", "full")
        of_all |= {"missing_entity": F.col("n").isNull(), "unexpected_entity": F.col("need").isNull()}
    broken = lambda rules: F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()]))).alias("rule")
    offenders = lists.select(broken(own), "id").unionByName(seen.select(broken(of_all), "id"))
    if known is not None:
        ids = lists.select(F.explode("ids").alias("id")).distinct()
        offenders = offenders.unionByName(ids.join(known.select(F.col("entity_id").alias("id")).distinct(), "id", "left_anti").withColumn("rule", F.lit("unknown_id")))
    return findings(offenders)


def check_subset(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """A warning for entities with a match that is no candidate of theirs."""
    m = matches.select(F.trim("source1_entity_id").alias("id"), _items(MATCHES[1]).alias("m"))
    c = candidates.select(F.trim("source1_entity_id").alias("id"), _items(CANDIDATES[1]).alias("c"))
    outside = m.join(c, "id", "left").where(F.size(F.array_except("m", F.coalesce("c", F.array().cast("array<string>")))) > 0)
    return findings(outside.select(F.lit("match_outside_candidates").alias("rule"), "id"), "warning")


def counts(rows: DataFrame, column: str) -> DataFrame:
    n = F.size(_items(column))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum((n == 0).cast("long")), F.lit(0)).alias("empty"), F.coalesce(F.sum((n > 0).cast("long")), F.lit(0)).alias("filled"))


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def exit_code(self) -> int:
        return int(bool(self.errors))


def _lines(spark: SparkSession, path: str, header: tuple[str, ...], report: Report) -> DataFrame | None:
    """The file's rows by tab, or None with the reason in the report."""
    from kinlink.sources.io import exists

    if not exists(spark, path):
        report.errors.append(f"{path}: missing")
        return None
    lines = spark.read.text(path)
    head = lines.head()
    if head is None or not head[0].strip():
        report.errors.append(f"{path}: empty")
        return None
    first = head[0]
    broken = lines.where(~F.is_valid_utf8("value")).count()
    if broken:
        report.errors.append(f"{path}: not UTF-8 ({broken} lines)")
        return None
    if "\t" not in first and "," in first:
        report.errors.append(f"{path}: separated by commas, not tabs")
        return None
    if tuple(x.strip().lower() for x in first.split("\t")) != header:
        report.errors.append(f"{path}: header {first!r}")
        return None
    body = lines.where((F.col("value") != first) & (F.trim("value") != ""))
    loose = body.where(F.instr("value", "\t") == 0).count()
    if loose:
        report.errors.append(f"{path}: {loose} rows without a tab")
    parts = F.split("value", "\t", 2)
    return body.where(F.instr("value", "\t") > 0).select(F.get(parts, F.lit(0)).alias(header[0]), F.get(parts, F.lit(1)).alias(header[1]))


def validate(spark: SparkSession, matching: str, candidate: str, required: DataFrame | None = None, known: DataFrame | None = None) -> Report:
    """Both files against all rules; known switches the check of ids on. Without a candidate file only a warning says so."""
    from kinlink.sources.io import exists

    report, tables = Report(), {}
    for path, header in ((matching, MATCHES), (candidate, CANDIDATES)):
        if header is CANDIDATES and not exists(spark, path):
            report.warnings.append(f"{path}: missing, not checked")
            tables[header] = None
            continue
        rows = tables[header] = _lines(spark, path, header, report)
        if rows is not None:
            for f in check_lists(rows, header[1], required, known).collect():
                report.errors.append(f"{path}: {f.rule}: {f['count']}, such as {', '.join(f.examples)}")
    if all(t is not None for t in tables.values()):
        for f in check_subset(tables[MATCHES], tables[CANDIDATES]).collect():
            report.warnings.append(f"{f.rule}: {f['count']}, such as {', '.join(f.examples)}")
    return report
