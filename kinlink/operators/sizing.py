"""Uncapped pair counts of candidate blocking rules, in SQL over the two sides, before any rule is used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.functions import text
from kinlink.operators.blocking import BudgetExceeded, met

COUNTRY = "l.country_norm = r.country_norm"
RULES = {
    "prefix4": f"{COUNTRY} AND substring(l.name_norm, 1, 4) = substring(r.name_norm, 1, 4)",
    "prefix5": f"{COUNTRY} AND substring(l.name_norm, 1, 5) = substring(r.name_norm, 1, 5)",
    "prefix6": f"{COUNTRY} AND substring(l.name_norm, 1, 6) = substring(r.name_norm, 1, 6)",
    "first_token": f"{COUNTRY} AND regexp_extract(l.name_norm, '[^ ]+', 0) = regexp_extract(r.name_norm, '[^ ]+', 0)",
    "sdx1": f"{COUNTRY} AND l.sdx1 = r.sdx1",
    "sorted_two": f"{COUNTRY} AND sort_array(slice(l.name_tokens, 1, 2)) = sort_array(slice(r.name_tokens, 1, 2))",
}


MOST = 15_000_000


def _sql(left: DataFrame, right: DataFrame, query: str, **more: DataFrame) -> DataFrame:
    """query over {l} and {r}, both with the phonetic code of their first token; no view outlives it."""
    coded = lambda d: d.withColumn("sdx1", text.soundex4(F.get("name_tokens", F.lit(0))))
    return left.sparkSession.sql(query, l=coded(left), r=coded(right), **more)


def _values(rule: str) -> list[tuple[str, str]]:
    """The expressions of l and of r that a rule sets equal."""
    return [tuple(x.strip() for x in part.split(" = ")) for part in RULES[rule].split(" AND ")]


def _sides_by(left: DataFrame, right: DataFrame, rule: str) -> list[DataFrame]:
    """Both sides as (entity_id, ks) with the rule's values as their one key; a null in it equals nothing."""
    sides = []
    for name, each in zip("lr", zip(*_values(rule))):
        known = " AND ".join(f"{e} IS NOT NULL" for e in each)
        key = ", ".join(f"'k{i}', {e}" for i, e in enumerate(each))
        sides.append(_sql(left, right, f"SELECT entity_id, array(named_struct({key})) AS ks FROM {{{name}}} {name} WHERE {known}"))
    return sides


def rule_size(left: DataFrame, right: DataFrame, rule: str) -> DataFrame:
    """(rule, pairs). Each side is counted by the rule's value, and the counts are joined: no pair is made."""
    one, other = zip(*_values(rule))
    keys = ", ".join(f"{e} AS k{i}" for i, e in enumerate(one)), ", ".join(f"{e} AS k{i}" for i, e in enumerate(other))
    names = ", ".join(f"k{i}" for i in range(len(one)))
    return _sql(left, right, f"""
        WITH a AS (SELECT {names}, count(*) AS n FROM (SELECT {keys[0]} FROM {{l}} l) GROUP BY {names}),
             b AS (SELECT {names}, count(*) AS n FROM (SELECT {keys[1]} FROM {{r}} r) GROUP BY {names})
        SELECT '{rule}' AS rule, coalesce(CAST(sum(a.n * b.n) AS BIGINT), 0) AS pairs FROM a JOIN b USING ({names})""")


def rule_pairs(left: DataFrame, right: DataFrame, rule: str, budget: int | None = None) -> DataFrame:
    """The pairs of a rule, one for each pair of rows (or of "tokens": the distinct pairs that share a name token); a
    budget is held against its size first."""
    if budget is not None:
        size = (token_overlap(left, right) if rule == "tokens" else rule_size(left, right, rule)).head()["pairs"]
        if size > budget:
            raise BudgetExceeded(f"{size} pairs by {rule}; the budget is {budget}")
    if rule == "tokens":
        own = lambda d: d.select("entity_id", F.explode("name_tokens").alias("t")).where("t is not null").groupBy("entity_id").agg(F.array_sort(F.collect_set("t")).alias("ks"))
        return met(own(left), own(right)).where("entity_id_l <> entity_id_r")
    return met(*_sides_by(left, right, rule)).where("entity_id_l <> entity_id_r")


def measured(left: DataFrame, right: DataFrame, rules=(*RULES, "tokens"), most: int = MOST) -> DataFrame:
    """(rule, pairs, kept): the size of each rule, and whether it is within budget."""
    sizes = [token_overlap(left, right).select(F.lit("tokens").alias("rule"), "pairs") if r == "tokens" else rule_size(left, right, r) for r in rules]
    return reduce(DataFrame.unionByName, sizes).withColumn("kept", F.col("pairs") <= most)


def affordable(left: DataFrame, right: DataFrame, rules: list[str], most: int = MOST) -> list[str]:
    """The rules whose measured size is within budget."""
    kept = {r.rule for r in measured(left, right, rules, most).collect() if r.kept}
    return [r for r in rules if r in kept]


def token_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pairs): rows of the join on a shared name token, counted by token."""
    return _sql(left, right, """
        WITH a AS (SELECT t, count(*) AS n FROM {l} LATERAL VIEW explode(name_tokens) AS t GROUP BY t),
             b AS (SELECT t, count(*) AS n FROM {r} LATERAL VIEW explode(name_tokens) AS t GROUP BY t)
        SELECT coalesce(CAST(sum(a.n * b.n) AS BIGINT), 0) AS pairs FROM a JOIN b USING (t)""")


def truth_with_shared_token(left: DataFrame, right: DataFrame, truth: DataFrame) -> DataFrame:
    """(hit): true pairs whose records share a name token, by a correlated EXISTS that becomes a semi-join."""
    return _sql(left, right, """
        WITH a AS (SELECT entity_id, t FROM {l} LATERAL VIEW explode(name_tokens) AS t),
             b AS (SELECT entity_id, t FROM {r} LATERAL VIEW explode(name_tokens) AS t),
             p AS (SELECT g.entity_id_l, g.entity_id_r, a.t FROM {g} g JOIN a ON a.entity_id = g.entity_id_l)
        SELECT count(DISTINCT struct(p.entity_id_l, p.entity_id_r)) AS hit FROM p
        WHERE EXISTS (SELECT 1 FROM b WHERE b.entity_id = p.entity_id_r AND b.t = p.t)""", g=truth)
