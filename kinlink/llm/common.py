"""What several operators share: the shared folder, row slices, prefix sums over skewed groups, bounded caches."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. The cluster names it in spark.checkpoint.dir. Where that is unset a temporary
    one is made, but on one machine only: on a cluster it would be lost to the executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if named:
        if have.isEmpty():
            sc.setCheckpointDir(named)
        return named
    if have.isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinlink-"))
    return sc._jsc.sc().getCheckpointDir().get()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that was written in the shared folder, with whatever file system its path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: like checkpoint(), but compressed and read by column."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/kinlink-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 512):
    """Arrow batches in parts of a few rows: Python objects of one part at a time are in memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small_batches(spark: SparkSession, rows: int = 512, size: str = "8m") -> None:
    """Texts go to Python in Arrow batches of few rows and bytes, so that neither side holds thousands of long texts. Set
    only where the session has Spark's default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


SMALL_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df of one or two numbers a row, kept in the shared folder and counted: broadcast in joins up to SMALL_ROWS rows
    (some 16 MB), joined by shuffle beyond. Without it the other side is shuffled before the size is known."""
    kept = checkpoint(df)
    return F.broadcast(kept) if kept.count() <= SMALL_ROWS else kept


def group_key(source: Column) -> Column:
    """A string that sorts as the source by code point, null last, and joins like any other value."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def slice_bits(rows: int, per_slice: int = 1000) -> int:
    """So many leading bits of a hash that a slice of it holds about per_slice rows; 8 to 20."""
    return min(20, max(8, (max(1, rows // per_slice) - 1).bit_length()))


def running_sums(df: DataFrame, group: str, order: str, value: str, out: str, bits: int) -> DataFrame:
    """df with out: the sum of value over the rows of the group before this one, by `order` (a hash of 64 bits).

    A group may hold most rows, so no window spans one: rows are dealt by group and the leading bits of the hash, sums
    of these slices are added up in a small table (2**bits rows a group), and only the slice is sorted."""
    cut = F.shiftright(F.col(order), 64 - bits)
    rows = df.withColumn("__slice", cut)
    sums = rows.groupBy(group, "__slice").agg(F.sum(value).alias("__sum"))
    before = sums.select(
        F.col(group).alias("__g"), F.col("__slice").alias("__s"),
        (F.sum("__sum").over(Window.partitionBy(group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")).alias("__before"),
    )
    ties = [c for c in df.columns if c not in (group, order)]
    inner = Window.partitionBy(group, "__slice").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn(out, F.sum(value).over(inner) - F.col(value))
    joined = placed.join(before, (F.col(group) == F.col("__g")) & (F.col("__slice") == F.col("__s")))
    return joined.withColumn(out, F.col(out) + F.col("__before")).drop("__slice", "__g", "__s", "__before")


_KEPT: list = []


def kept(f):
    """A cache of a worker that outlives its task, as the tokenizer and the words seen are used again by the next; of the
    few last arguments. release() empties all of them."""
    cached = lru_cache(maxsize=4)(f)
    _KEPT.append(cached)
    return cached


def release() -> None:
    """At the start of a task that uses no cache: Python workers outlive stages, so the caches of the operators that ran
    before are emptied, and what the allocators hold back is returned."""
    for cached in _KEPT:
        cached.cache_clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


class Bounded(dict):
    """A cache that takes up to `most` short keys and answers the rest without keeping them. Words come by falling
    frequency, so what comes first is what comes often. Keys over 64 bytes are never kept."""

    def __init__(self, answer, most: int, start=()):
        super().__init__(start)
        self.answer, self.most = answer, most

    def __missing__(self, key):
        out = self.answer(key)
        if len(self) < self.most and len(key) <= 64:
            self[key] = out
        return out
