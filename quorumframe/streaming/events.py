"""Streams of dated events: windowed counts, sessions, deduplication, incremental tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quorumframe.operators.joins import resume


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need instants; times without a zone are taken in that of the session."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, *, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count and sum of value by window and event_type; rows later than late are left out, so state stays bounded."""
    w = F.window("ts", window, slide or window)
    return _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, *, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return _timed(events, late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, key: str, *, late: str = "10 minutes") -> DataFrame:
    """First arrivals of each key; a key is forgotten once it is older than late."""
    return _timed(events, late).dropDuplicatesWithinWatermark([key])


def append_incrementally(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends to the table at path what it does not have yet; a batch that is run again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        from quorumframe.sources.files import _exists

        spark = batch.sparkSession
        once = batch.dropDuplicates([key])
        fresh = resume(once, spark.read.parquet(path), key) if _exists(spark, path) else once
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
