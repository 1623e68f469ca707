"""Streams of episodes and events.  Event and arrival times are watermarked, so that state is dropped after its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, keys: list[str], at: str, within: str = "3 days") -> DataFrame:
    """The first delivery of each key; state is kept for ``within`` of ``at``, which bounds it."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def revisions(stream: DataFrame, cutoff: str = "72 hours") -> DataFrame:
    """``namespace, period, report_day, added`` of late arrivals within the cut-off, updated as they come.

    ``stream`` has id, namespace, occurred_at, ingested_at.  A period closes when its day ends; ids are counted once, at their first arrival.
    The watermark runs on the arrival time, so the counts of a report day are final and their state dropped once it is past.
    """
    rows = stream.select("id", "namespace", F.col("occurred_at").cast("timestamp").alias("occurred_at"), F.col("ingested_at").cast("timestamp").alias("ingested_at"))
    once = rows.withWatermark("ingested_at", cutoff).dropDuplicatesWithinWatermark(["id"])
    close = F.date_trunc("day", "occurred_at") + F.expr("interval 1 day")
    late = once.filter((F.col("ingested_at") >= close) & (F.col("ingested_at") < close + F.expr(f"interval {cutoff}")))
    return late.groupBy(F.window("ingested_at", "1 day").alias("w"), "namespace", F.date_format("occurred_at", "yyyy-MM-dd").alias("period")).agg(F.count(F.lit(1)).alias("added")).select(
        "namespace", "period", F.date_format("w.start", "yyyy-MM-dd").alias("report_day"), "added")


def rates(stream: DataFrame, at: str = "ts", size: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Events per window and type."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    return rows.groupBy(F.window(at, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")


def snapshots(stream: DataFrame, path: str, checkpoint: str):
    """A query that appends closed windows to ``path`` in micro-batches; files are the only sink that restarts keep exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
