"""Event-time windows over an event table.  Events without a time belong to no window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "events", "total")


def sliding(events: DataFrame, size: str = "6 hours", slide: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "events")


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Sessions per user: a silence of the gap or more ends one."""
    w = F.session_window("ts", f"{gap_minutes} minutes")
    return events.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


def last_points(events: DataFrame, n: int = 60) -> DataFrame:
    """The ring buffer: the newest ``n`` points of each type."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.select("event_type", "event_id", "ts", "value").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("event_type", "rank", "event_id", "value")
