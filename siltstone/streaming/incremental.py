"""Incremental runs as Structured Streaming: append-only ledgers, keyed upserts and latest views.

Windows over event time are not part of the storage queries; ``event_windows`` is an extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import latest


def append_ledger(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is there to a ledger once and end, as a timer would start it."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_view(spark: SparkSession, path: str, keys: list[str], *order: str) -> DataFrame:
    return latest.latest_per_key(spark.read.parquet(path), keys, *order)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], sequence: str) -> None:
    """Keep the last write of each key in one of two table versions; a batch that runs again gives the same version."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = f"{path}/v{(batch_id + 1) % 2}"
        rows = batch
        try:
            rows = spark.read.parquet(old).unionByName(batch) if batch_id else batch
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        latest.last_write_wins(rows, keys, sequence).select(batch.columns).write.mode("overwrite").parquet(f"{path}/v{batch_id % 2}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_windows(events: DataFrame, ts: str, keys: list[str], value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window; works on streams and tables."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
