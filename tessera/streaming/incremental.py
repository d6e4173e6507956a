"""Incremental jobs: new documents to targets, and the latest response per key, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.targets import dedupe_targets, extract_targets


def stream_targets(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, key: str = "record_id") -> StreamingQuery:
    """Deduplicated targets of every Parquet file of records that arrives in ``source``, appended to ``out`` until no file is new.

    Every batch goes to a folder of its own number, overwritten when the batch is run again, so that a restart after a
    loss neither drops nor doubles rows.
    """
    records = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        dedupe_targets(extract_targets(batch), key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(events: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per window and ``by``, with rows later than ``late`` after the newest dropped; for a streaming frame in append mode."""
    w = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), by, "n")
