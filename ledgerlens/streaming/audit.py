"""Streams over the audit log and event table. New capability: the batch operators have no stream counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = "ts timestamp, event string, decision string, host string, purpose string, payload_bytes long"


def read_audit_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(AUDIT_SCHEMA).json(folder)


def host_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Requests by host, decision and tumbling window; events later than ``late`` behind are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "host", "decision").agg(F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("bytes")).select(F.col("window.start").alias("start"), "host", "decision", "n", "bytes")


def sessions(events: DataFrame, user: str, at: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user, start, end, n: events with less than ``gap`` between them; works on streams and tables."""
    if late:
        events = events.withWatermark(at, late)
    return events.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_restatements(facts: DataFrame, keys: list[str], late: str = "400 days") -> DataFrame:
    """A running latest-filed value for each key and period end, for update or complete output."""
    return facts.withWatermark("filed", late).groupBy(*keys, "end").agg(F.max_by("val", "filed").alias("val"), F.max("filed").alias("filed"))
