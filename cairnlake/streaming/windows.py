"""Windows by gaps over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_windows(events: DataFrame, gap: int = 900, late: str = "1 hour") -> DataFrame:
    """session_id, started_at, ended_at (epoch seconds), queries of events(ts epoch, session_id). Works on
    batches and streams; in a stream a window is final once the watermark has passed it. An event at exactly gap
    seconds after a window's end joins it."""
    e = events.withColumn("at", F.timestamp_seconds("ts"))
    e = e.withWatermark("at", late) if e.isStreaming else e
    w = e.groupBy("session_id", F.session_window("at", f"{gap} seconds").alias("w")).agg(F.count("*").alias("queries"))
    start, end = F.unix_timestamp("w.start"), F.unix_timestamp("w.end") - gap
    return w.select("session_id", start.alias("started_at"), end.alias("ended_at"), "queries")
