"""Read queries on the ledger (W1-W3) and source selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.operators.sizes import broadcast_if_small

PREVIEW_CHARS = 60


def _tie(df: DataFrame) -> list[str]:
    return [c for c in ("source_path", "end_offset", "session_id") if c in df.columns]


def query_session(ledger: DataFrame, session_id: str) -> DataFrame:
    """Turns of one session, oldest first."""
    return ledger.filter(F.col("session_id") == session_id).orderBy("ts_ms", *_tie(ledger))


def query_recent(ledger: DataFrame, tool: str, n: int) -> DataFrame:
    """Latest turns of a tool; Spark keeps n rows per task, never the whole sort."""
    return ledger.filter(F.col("tool") == tool).orderBy(F.desc("ts_ms"), *[F.desc(c) for c in _tie(ledger)]).limit(n)


def status(ledger: DataFrame, enabled_tools: DataFrame, n: int = 3) -> DataFrame:
    """Latest ``n`` turns of every enabled tool with a preview; a tool without turns shows one empty row."""
    w = Window.partitionBy("tool").orderBy(F.desc("ts_ms"), *[F.desc(c) for c in _tie(ledger)])
    top = ledger.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(
        "tool", "rank", "ts_ms", "role", F.substring("content", 1, PREVIEW_CHARS).alias("preview")
    )
    return enabled_tools.select("tool").distinct().join(top, "tool", "left")


def enabled_only(df: DataFrame, enabled_tools: DataFrame) -> DataFrame:
    """P24, J5."""
    return df.join(broadcast_if_small(enabled_tools.select("tool").distinct()), "tool", "left_semi")


def newest_per_project(files: DataFrame) -> DataFrame:
    """Newest ``.jsonl`` per project directory of ``files(project, path, mtime)``; an aggregation, no window."""
    newest = F.max_by(F.struct("path", "mtime"), F.struct(F.col("mtime"), F.col("path")))
    return (
        files.filter(F.endswith("path", F.lit(".jsonl")))
        .groupBy("project")
        .agg(newest.alias("f"))
        .select("project", "f.path", "f.mtime")
    )


def active_source(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Per project the newest source whose first record names it as working directory, else the newest of all.

    ``files(path, mtime, cwd)``. The overall newest is a scalar subquery.
    """
    order = F.struct("mtime", "path")
    matched = files.filter("cwd is not null").groupBy("cwd").agg(F.max_by("path", order).alias("matched"))
    overall = files.agg(F.max_by("path", order).alias("overall"))
    return projects.join(matched, projects["project"] == matched["cwd"], "left").select(
        "project", F.coalesce(F.col("matched"), overall.scalar()).alias("path")
    )
