"""Hook and watch notifications: validation (P21, F19), project routing (P25, P26), coalescing (T3), event kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.schemas import TOOLS

DEBOUNCE = "250 milliseconds"
KEPT_KINDS = ("create", "modify", "remove")


def has_parent_component(path: Column) -> Column:
    """does the path contain a ``..`` component?"""
    return F.coalesce(F.array_contains(F.split(path, "/"), ".."), F.lit(False))


def validate(events: DataFrame, max_body_bytes: int | None = None) -> DataFrame:
    """Adds ``reject_reason``; a relative or climbing ``cwd`` is blanked, not rejected.

    With a size limit a ``body`` column, if there is one, is held against it.
    """
    cwd = F.when(F.startswith("cwd", F.lit("/")) & ~has_parent_component(F.col("cwd")), F.col("cwd"))
    reason = F.when(~F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False)), "unknown tool").when(
        has_parent_component(F.col("transcript_path")), "transcript_path has parent component"
    )
    if max_body_bytes is not None and "body" in events.columns:
        reason = F.when(F.octet_length("body") > max_body_bytes, "body too large").otherwise(reason)
    return events.withColumn("reject_reason", reason).withColumn("cwd", cwd)


def keep_watch_kinds(events: DataFrame) -> DataFrame:
    """P27."""
    return events.filter(F.col("kind").isin(*KEPT_KINDS) | F.col("rescan"))


def coalesce_bursts(events: DataFrame, width: str = DEBOUNCE) -> DataFrame:
    """One row per tool, path and debounce window."""
    return (
        events.groupBy("tool", "path", F.window("ts", width).alias("w"))
        .agg(F.max("ts").alias("ts"), F.bool_or("rescan").alias("rescan"), F.count(F.lit(1)).alias("n_events"))
        .select("tool", "path", F.col("w.start").alias("window_start"), "ts", "rescan", "n_events")
    )


def slug(path: Column) -> Column:
    """P26."""
    return F.replace(path, F.lit("/"), F.lit("-"))


def unslug(text: Column) -> Column:
    """Lossy (Q13): a dash in a directory name comes back as a slash."""
    return F.replace(text, F.lit("-"), F.lit("/"))


def resolve_project(explicit: Column, session_cwd: Column, source_path: Column, home: Column) -> Column:
    """P25: explicit directory, else the session's, else decoded from the transcript's folder name; never the home directory."""
    folder = F.try_element_at(F.split(source_path, "/"), F.lit(-2))
    decoded = F.when(F.startswith(folder, F.lit("-")), unslug(folder))
    return F.coalesce(F.nullif(explicit, home), F.nullif(session_cwd, home), F.nullif(decoded, home))
