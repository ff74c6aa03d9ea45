"""Notification streams: hook events, watch events and their coalescing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import hooks
from sessionloom.schemas import HOOK_EVENTS


def hook_stream(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes landed as JSON files."""
    return spark.readStream.schema(HOOK_EVENTS).json(path)


def signals(hook_events: DataFrame, watch_events: DataFrame) -> DataFrame:
    """Both notification streams as ``tool, path, session_id, ts, rescan``.

    Invalid hook envelopes are dropped here (``hooks.validate`` reports them). A watch event without a path asks for a rescan.
    """
    pushed = hooks.validate(hook_events).filter("reject_reason is null").select(
        "tool",
        F.coalesce("transcript_path", F.lit("")).alias("path"),
        F.coalesce("session_id", F.lit("default")).alias("session_id"),
        "ts",
        F.lit(False).alias("rescan"),
    )
    seen = hooks.keep_watch_kinds(watch_events).select(
        "tool", "path", F.lit("default").alias("session_id"), "ts", (F.col("rescan") | (F.col("path") == "")).alias("rescan")
    )
    return pushed.unionByName(seen)


def coalesced(stream: DataFrame, lateness: str = "1 second") -> DataFrame:
    """One signal per tool, path and debounce window."""
    return hooks.coalesce_bursts(stream.withWatermark("ts", lateness))
