"""Reading and writing: TSV sources and ground truth, cached normalised tables, packed id lists, logs, policies."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.functions import text

SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
NORMALISED = "entity_id string, name_norm string, name_tokens array<string>, addr_norm string, country_norm string"
#: The evaluation log's columns, fixed so that rows never drift from the header.
LOG = (
    "run string, split string, policy string, recall_s2 double, recall_s3 double, pairs_s2 long, pairs_s3 long, mean_s2 double, mean_s3 double, "
    "median_s2 double, median_s3 double, p90_s2 double, p90_s3 double, max_s2 long, max_s3 long, zero_s2 long, zero_s3 long, reduction_s2 double, "
    "reduction_s3 double, threshold double, macro_f double, pair_precision double, pair_recall double, pair_f double, singletons long, singletons_right long, elapsed_s double"
)


def source_path(root: str, split: str, n: int) -> str:
    return f"{root}/{split}/{split}_source{n}.tsv"


def ground_truth_path(root: str, split: str) -> str:
    return f"{root}/{split}/{split}_ground_truth.tsv"


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Columns are found by the header, whatever others the file has; empty fields are null."""
    with_header = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("enforceSchema", False)
    head = with_header.csv(path, inferSchema=False).columns
    whole = T.StructType([T.StructField(c, T.StringType()) for c in head])
    return with_header.schema(whole).csv(path).select(*[F.col(f.name) for f in schema])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scratch(spark: SparkSession) -> str:
    """A new folder for intermediate tables, below the one that spark.checkpoint.dir names; on one machine, where that is
    unset, a temporary one."""
    import re
    import tempfile
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.gettempdir()}"
    return f"{named.rstrip('/')}/kinlink-{uuid.uuid4().hex}"


def read_source(spark: SparkSession, root: str, split: str, n: int) -> DataFrame:
    return read_tsv(spark, source_path(root, split, n), SOURCE)


def read_ground_truth(spark: SparkSession, root: str, split: str) -> DataFrame:
    """The packed truth; an empty table where the split has none."""
    path = ground_truth_path(root, split)
    return read_tsv(spark, path, TRUTH) if exists(spark, path) else spark.createDataFrame([], TRUTH)


def normalised(source: DataFrame, scripts: bool = True) -> DataFrame:
    """entity_id, name_norm, name_tokens, addr_norm, country_norm of a source table."""
    named = source.select("entity_id", text.norm_name(F.col("business_name"), scripts).alias("name_norm"), text.norm_address(F.col("business_address")).alias("addr_norm"), text.norm_country(F.col("country")).alias("country_norm"))
    return named.select("entity_id", "name_norm", text.words_of(F.col("name_norm")).alias("name_tokens"), "addr_norm", "country_norm")


def cached_normalised(source: DataFrame, path: str, force: bool = False) -> DataFrame:
    """The normalised table at path, made first if it isn't there (or if forced)."""
    spark = source.sparkSession
    if force or not exists(spark, f"{path}/_SUCCESS"):
        normalised(source).write.mode("overwrite").parquet(path)
    return spark.read.schema(NORMALISED).parquet(path)


def write_id_lists(lists: DataFrame, path: str) -> None:
    """Tab-separated with a header; empty lists are empty fields, without quotes."""
    lists.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in lists.columns]).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").option("quote", "").csv(path)


def write_single(lists: DataFrame, path: str) -> None:
    """Like write_id_lists, as one file: parts are written side by side and then strung together, byte by byte."""
    spark = lists.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parts = f"{path}.parts"
    lists.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in lists.columns]).write.mode("overwrite").option("sep", "\t").option("header", False).option("emptyValue", "").option("nullValue", "").option("quote", "").csv(parts)
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    out = fs.create(target, True)
    try:
        out.write(bytearray(("\t".join(lists.columns) + "\n").encode()))
        for f in sorted((f.getPath() for f in fs.listStatus(folder)), key=lambda p: p.getName()):
            if f.getName().startswith("part-"):
                part = fs.open(f)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                part.close()
    finally:
        out.close()
    fs.delete(folder, True)


def read_parquets(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """Several Parquet tables of one shape as one scan, with the columns asked for."""
    rows = spark.read.parquet(*paths)
    return rows.select(*columns) if columns else rows


def write_report(rows: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """(entity_id, embedding) as Parquet of floats; the table that neighbours are searched in."""
    vectors.select("entity_id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema("entity_id string, embedding array<float>").parquet(*paths)


def append_log(row: DataFrame, path: str) -> None:
    schema = T._parse_datatype_string(LOG)
    row.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in row.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").option("header", True).csv(path)


def save_policy(spark: SparkSession, policy: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(policy, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_policy(spark: SparkSession, path: str, default: float = 0.55) -> dict:
    """A saved policy; where there is none, the flat threshold."""
    if not exists(spark, path):
        return {"keep_threshold": default, "fallback_top1_threshold": default, "singleton_cutoff": 0.0}
    return json.loads(spark.read.text(path).head()[0])
