"""New canonical records as a stream, matched against the static side's keys and scored with its records.

Frequent keys of the static side are out from the start, by each pass's own limit; a key's product is held to the pass's
limit with the rows of the batch. A stream that comes in one batch gives what blocking.multipass() gives, up to keys that
are frequent among the new records only: those can't be known before the stream has ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.operators import features, keys
from kinlink.operators.blocking import counts, limits
from kinlink.operators.model import plain_score
from kinlink.sources.io import normalised


def stream_source(spark, path: str) -> DataFrame:
    """A folder of TSV files of a source, read as they come."""
    from kinlink.sources.io import SOURCE

    return spark.readStream.option("sep", "\t").option("header", True).schema(SOURCE).csv(path)


def static_keys(right: DataFrame, passes: list[keys.Pass]) -> DataFrame:
    """(pass, key, entity_id_r, n2) of the keys within their pass's limit on the static side."""
    rows = keys.long_keys(right, passes)
    freq, _ = limits(passes)
    calm = counts(rows, "n2").where(F.col("n2") <= freq)
    return rows.join(calm, ["pass", "key"]).select("pass", "key", F.col("entity_id").alias("entity_id_r"), "n2")


def match_batch(batch: DataFrame, right: DataFrame, held: DataFrame, passes: list[keys.Pass], threshold: float) -> DataFrame:
    """(entity_id_l, entity_id_r, prob) of one micro-batch; held: static_keys()."""
    norm = normalised(batch)
    own = keys.long_keys(norm, passes)
    freq, pairs = limits(passes)
    calm = counts(own, "n1").where(F.col("n1") <= freq)
    met = own.join(calm, ["pass", "key"]).join(held, ["pass", "key"]).where(F.col("n1") * F.col("n2") <= pairs)
    found = met.select(F.col("entity_id").alias("entity_id_l"), "entity_id_r").distinct()
    scored = plain_score(features.native_features(found, norm, right))
    return scored.where(F.col("prob") >= threshold).select("entity_id_l", "entity_id_r", "prob")


def start(stream: DataFrame, right: DataFrame, passes: list[keys.Pass], sink: str, checkpoint: str, threshold: float = 0.5):
    """A query that appends each batch's matches to Parquet, exactly once: a batch writes its own folder anew. The static
    side's keys are written beside the checkpoint before the stream starts, and only read by the batches."""
    spark = right.sparkSession
    held = static_keys(right, passes)
    held.write.mode("overwrite").parquet(f"{checkpoint}-keys")
    held = spark.read.schema(held.schema).parquet(f"{checkpoint}-keys")

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # read three times: counts, keys and features
        try:
            match_batch(kept, right, held, passes, threshold).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
