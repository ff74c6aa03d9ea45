"""Idle sessions on a live stream (T4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.windows import IDLE_GAP_SECONDS


def idle_session_stream(events: DataFrame, key: str, ts: str, lateness: str = "10 minutes", gap_seconds: int = IDLE_GAP_SECONDS) -> DataFrame:
    """Closed sessions of a key, in append mode.

    A session window merges events that are exactly its gap apart, while here such a gap separates, so the window is one
    microsecond shorter. Sessions are merged within a partition before they are shuffled, which takes the load off a hot key.
    """
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    gap = f"{gap_seconds - 1} seconds 999999 microseconds"
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, lateness)
        .groupBy(F.col(key), F.session_window(ts, gap).alias("w"))
        .agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("n_events"))
        .select(key, "session_start", "session_end", "n_events")
    )
