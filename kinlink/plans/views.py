"""Linkage tables derived from the driver's tables, once for Spark and, as the same SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.sources.io import normalised

BIZ = """
SELECT concat('S', CAST(1 + p_partkey % 3 AS STRING), '-', CAST(p_partkey AS STRING)) AS entity_id,
       concat(p_name, ' ', p_type, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN ' Ltd.' WHEN 1 THEN ' & Co' WHEN 2 THEN ' Private Limited' ELSE '' END) AS business_name,
       concat(CAST(p_size AS STRING), ' Main St, Suite ', CAST(p_size * 2000 AS STRING), ', ', CASE CAST(p_size % 3 AS INT) WHEN 0 THEN 'TX' WHEN 1 THEN 'NY' ELSE 'CA' END) AS business_address,
       CASE CAST(p_partkey % 2 AS INT) WHEN 0 THEN ' US ' ELSE 'India' END AS country
FROM part"""
TRUTH = """
SELECT concat('S1-', CAST(a.p_partkey AS STRING)) AS entity_id_l, concat('S', CAST(1 + b.p_partkey % 3 AS STRING), '-', CAST(b.p_partkey AS STRING)) AS entity_id_r
FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_type = b.p_type
WHERE a.p_partkey % 3 = 0 AND b.p_partkey % 3 <> 0"""
SCORED = """
SELECT CAST(l_orderkey AS STRING) AS entity_id_l, CAST(l_partkey AS STRING) AS entity_id_r, CAST(l_suppkey % 2 AS INT) AS src,
       MAX(((l_partkey * 7919 + l_orderkey * 104729) % 1000) / CAST(1000 AS DOUBLE)) AS prob,
       MAX(CASE WHEN (l_partkey * 31 + l_orderkey * 17) % 5 = 0 THEN 1 ELSE 0 END) AS label
FROM lineitem GROUP BY 1, 2, 3"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, name: str, query: str) -> DataFrame:
    return spark.sql(query.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name} b", f"JOIN {{{name}}} b"), **{name: table(spark, sf_dir, name)})


def biz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out where the file is one or a few partitions: its rows take some time each."""
    rows = _sql(spark, sf_dir, "part", BIZ)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """biz, normalised; its names are ASCII, so no script has to be romanised."""
    return normalised(biz(spark, sf_dir), scripts=False)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """S1, and S2 with S3."""
    n = norm(spark, sf_dir)
    return n.where(F.col("entity_id").startswith("S1-")), n.where(~F.col("entity_id").startswith("S1-"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined by shuffle: a small file may hold more rows than the driver can broadcast."""
    return _sql(spark, sf_dir, "part", TRUTH.replace("SELECT", "SELECT /*+ MERGE(a, b) */", 1))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "lineitem", SCORED)
