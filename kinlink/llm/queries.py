"""The operators' queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import ann, mips, mixing, packing, quality, secrets, simhash, tokens, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.graded(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips.top_products(_table(spark, sf_dir, "embeddings"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def nearest_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_nearest with scores to nine places, for the comparison with SQL."""
    return op2_nearest(spark, sf_dir).withColumn("score", F.round("score", 9))


def mixing_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_mixing by source, for the comparison with SQL: sizes, targets, and whether the words taken come near them."""
    by = op3_mixing(spark, sf_dir).groupBy("source_size", "target").agg(F.count(F.lit(1)).alias("docs"), F.sum("taken").alias("taken"))
    near = F.abs(F.col("taken") - F.col("target")) <= F.col("target") / 200 + 2
    return by.select("source_size", F.round("target", 6).alias("target"), "docs", near.alias("near"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op8_secrets, for the comparison with SQL."""
    return op8_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def queries() -> dict:
    own = (op1_simhash, op2_nearest, op3_mixing, op4_urls, op5_packing, op6_quality, op7_products, op8_secrets, op9_toxicity, op10_tokens, nearest_rounded, mixing_by_source, secret_counts)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
    nearest = """
WITH v AS (SELECT vec_id, {vector} AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 {more}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, {score} AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS "rank", vec_id, score FROM r WHERE n <= 5"""
    goal, over = "", ""
    for i in range(6):  # six rounds of resharing are more than 20 sources of the driver's tables need
        last = f"g{i - 1}" if i else "w0"
        goal += f""", l{i} AS (SELECT *, {"0.0::DOUBLE AS target, false AS done" if not i else "target, done"} FROM {last}),
r{i} AS (SELECT (SELECT sum(s) FROM l{i}) - coalesce((SELECT sum(target) FROM l{i} WHERE done), 0) AS rest, (SELECT sum(w) FROM l{i} WHERE NOT done) AS ws),
g{i} AS (SELECT source, s, docs, w, CASE WHEN done THEN target WHEN rest * w / ws > 3 * s THEN 3.0 * s ELSE rest * w / ws END AS target, done OR rest * w / ws > 3 * s AS done FROM l{i}, r{i})"""
        over = f"g{i}"
    return {
        "nearest_rounded": nearest.format(vector="list_transform(embedding, lambda x: CAST(x AS DOUBLE))", more="AND len(list_filter(embedding, lambda x: x <> 0)) > 0", score="list_cosine_similarity(q.v, c.v)").replace("vec_id, score FROM r", "vec_id, round(score, 9) AS score FROM r"),
        "mixing_by_source": rf"""
WITH w0 AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS w FROM (
  SELECT source, CAST(sum(coalesce(len(regexp_extract_all(text, '[^ 	-]+')), 0)) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS docs FROM documents GROUP BY source)){goal}
SELECT s AS source_size, round(target, 6) AS target, CAST(sum(docs) AS BIGINT) AS docs, true AS near FROM {over} GROUP BY s, target""",
        "secret_counts": r"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '((?i)password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
        "op4_urls": f"""
WITH r(verdict, host, path) AS (VALUES {rules}),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM pages),
m AS (SELECT u.n, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.n ORDER BY length(r.host || r.path) DESC) AS k
  FROM u JOIN r ON (u.host = r.host OR u.host LIKE '%.' || r.host) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.n = m.n AND m.k = 1""",
        "op7_products": nearest.format(vector="list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))", more="", score="CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT)"),
    }


