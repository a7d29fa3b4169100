"""Bounded samples of labelled documents for the classifiers, as hashed words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import slices, small, small_batches


#: Longer texts, in bytes, aren't learned from, so that a sample is bounded in bytes too. They are scored like any other.
LONGEST = 100_000


def held_out(doc_id) -> F.Column:
    """A quarter of the documents, by crc32 of the id as text: never learned from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled(labels: DataFrame, label: str) -> tuple[DataFrame, dict[int, int]]:
    """(__id, __label) of what may be learned from, and the number of rows for each label."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("__label")).dropna()
    known = known.groupBy("__id").agg(F.max("__label").alias("__label")).where(~held_out(F.col("__id")))
    return known, {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}


def everything(docs: DataFrame, known: DataFrame, hashed) -> DataFrame:
    """(id, label, words, lang) of all documents that known has a label for, of any length. hashed: bytes -> int32 array.
    Rows that repeat an id stay."""
    def encode(batches):
        for batch in slices(batches):
            data = [hashed(t).astype("<i4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary()), batch.column(3)], ["id", "label", "words", "lang"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"))
    met = rows.where(~held_out(F.col("id"))).join(small(known), F.col("id") == F.col("__id")).select("id", "__label", "text", "lang")
    return met.mapInArrow(encode, "id long, label int, words binary, lang string")


def sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, hashed, extra: tuple[str, ...] = ()) -> tuple[list[tuple], dict[int, int]]:
    """Up to per_label documents for each label (the first by a hash of the id, none of them held out), and the number of
    labelled documents there are. hashed: bytes -> int32 array. Only the hashes come to the driver, for whole texts.

    Labels with a null id or value are not used; of several for one id the largest counts; of repeated rows one."""
    known, numbers = labelled(labels, label)
    if not numbers:
        return [], {}
    chosen = None
    for value in sorted(numbers):
        part = known.where(F.col("__label") == value).orderBy(F.xxhash64("__id", F.lit(7)), "__id").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)

    def encode(batches):
        for batch in slices(batches):
            data = [hashed(t).astype("<i4").tobytes() for t in batch.column(2).to_pylist()]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary()), *[batch.column(i) for i in range(3, len(names))]], names)

    small_batches(docs.sparkSession)
    others = [F.col(c).cast("string").alias(f"__x{i}") for i, c in enumerate(extra)]
    rows = docs.select(F.col("doc_id").cast("long").alias("__d"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("__text"), *others)
    rows = rows.where(F.octet_length("__text") <= LONGEST)
    met = rows.join(F.broadcast(chosen), F.col("__d") == F.col("__id"))  # at most per_label rows for each label
    met = met.select("__id", "__label", "__text", *[f"__x{i}" for i in range(len(extra))])
    shape = "__id long, __label int, __text binary" + "".join(f", __x{i} string" for i in range(len(extra)))
    once = {}
    for r in met.mapInArrow(encode, shape).toLocalIterator():
        once.setdefault(r[0], (r[0], r[1], np.frombuffer(r[2], "<i4"), *r[3:]))
    return [once[k] for k in sorted(once)], numbers
