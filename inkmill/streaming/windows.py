"""Event-time windows. An extension: the reference processes no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> tuple[DataFrame, str]:
    """Events ready for windows, and the type of ts. Watermarks need timestamps with a time zone."""
    kind = dict(events.dtypes)["ts"]
    if not events.isStreaming:
        return events, kind
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), kind


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value per window and type; works on batch and streaming input alike."""
    rows, kind = _timed(events, late)
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast(kind).alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that end after a gap without events."""
    rows, kind = _timed(events, late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast(kind).alias("session_start"), "n")
