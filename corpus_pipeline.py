"""A corpus from raw documents: toxic ones go, near copies go, secrets are masked, sources are mixed, the rest is packed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinlink.llm import mixing, packing, resemblance, secrets, toxicity
from kinlink.llm.common import removed, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold; the classifier learns from sf_dir's labels. Null and empty texts, null
    ids and repeated rows are judged by their text like any other; without labels of both kinds all stay."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked fingerprints and of texts alike in five-word
    shingles. Null and empty texts are alike; rows with a null id all stay; of rows that share an id one stays."""
    return resemblance.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; null texts stay null."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents, so many that each source comes to its target. A null source is one of its own; rows
    without words stay once."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of which training sequences are made. Null and empty texts are an end token; null ids are kept."""
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack)]

#: Classifier, fingerprints' components and token ids have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written in the shared folder and read again by the next. A stage's
    table goes when the next one has been written; the last one's stays, as the result reads it. An empty table of
    documents gives an empty result; columns beside those of documents are carried to the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        out, path = stage(spark, docs, sf_dir), f"{folder}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
