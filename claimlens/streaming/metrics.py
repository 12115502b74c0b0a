"""Streams of audit events: windowed metrics with late data, duplicates dropped, sinks that do not fail the stream."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the files that arrive under path; ts is read as an instant, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Count and sum per window and type; rows later than the watermark are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def once(stream: DataFrame, late: str = "10 minutes", key: str = "event_id") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return stream.withWatermark("ts", gap).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def to_sinks(*sinks):
    """A foreachBatch function that writes to every sink; one that fails is logged and does not stop the others."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for sink in sinks:
            try:
                sink(batch, batch_id)
            except Exception:
                log.exception("sink failed for batch %s", batch_id)
        batch.unpersist()

    return run
