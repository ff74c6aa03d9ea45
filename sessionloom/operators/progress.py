"""Accumulation over batches: progress log (A7), task and next-action history (A8), last non-empty value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as tx
from sessionloom.operators.sizes import broadcast_if_small


def merge_progress(existing: DataFrame, new: DataFrame, allowed_lateness_s: int = 0) -> DataFrame:
    """New progress lines to append (A7, T5, X4): newer than the project's last logged line, distinct.

    ``existing(project, entry, ord)`` is the log so far, ``new(project, entry, ord)`` the batch; ``ord`` orders the log lines of a
    project. The comparison is on second-precision text and strict, so a turn in the same second as the last line counts as
    late; ``allowed_lateness_s`` moves the border back, and lines already logged are then removed by an anti join.
    """
    stamp = tx.bullet_ts(F.col("entry"))
    last = existing.groupBy("project").agg(F.max_by(stamp, F.col("ord")).alias("last_ts"))
    if allowed_lateness_s:
        moved = F.to_timestamp("last_ts") - F.make_dt_interval(secs=F.lit(float(allowed_lateness_s)))
        last = last.select("project", F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_ts"))
    # One row per project; a hot project's lines should not meet in one join task.
    fresh = (
        new.join(broadcast_if_small(last), "project", "left")
        .filter(F.col("last_ts").isNull() | (stamp > F.col("last_ts")))
        .groupBy("project", "entry")
        .agg(F.min("ord").alias("ord"))
    )
    if allowed_lateness_s:
        fresh = fresh.join(existing.select("project", "entry"), ["project", "entry"], "left_anti")
    return fresh.select("project", "entry", "ord")


def last_entries(log: DataFrame) -> DataFrame:
    """The last entry of each project's log."""
    return log.groupBy("project").agg(F.max_by(F.struct("entry", "ord"), "ord").alias("e")).select("project", "e.*")


def history(values: DataFrame) -> DataFrame:
    """Distinct first lines per project and section with the time they first appeared.

    ``values(project, section, value, ts_ms)``; empty values and ``<no …>`` placeholders never enter.
    """
    line = tx.first_line(F.col("value"))
    return (
        values.select("project", "section", line.alias("value"), "ts_ms")
        .filter((F.col("value") != "") & ~F.startswith("value", F.lit("<no ")))
        .groupBy("project", "section", "value")
        .agg(F.min("ts_ms").alias("first_seen_ms"))
    )


def history_delta(existing: DataFrame, values: DataFrame) -> DataFrame:
    """History rows of a batch that are not in the table yet."""
    return history(values).join(existing, ["project", "section", "value"], "left_anti")


def newest_history(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest-first history bullets, all or a number of them per project and section."""
    w = Window.partitionBy("project", "section").orderBy(F.desc("first_seen_ms"), F.asc("value"))
    bullet = F.concat(F.lit("- ["), tx.ms_to_iso(F.col("first_seen_ms")), F.lit("] "), F.col("value"))
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return (ranked if limit is None else ranked.filter(F.col("rank") <= limit)).select(
        "project", "section", "rank", bullet.alias("bullet")
    )


def last_non_empty(df: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """Latest non-empty value per key (A9), by partial aggregation."""
    kept = F.nullif(F.col(value), F.lit(""))
    return df.groupBy(key).agg(F.max_by(kept, F.when(kept.isNotNull(), order)).alias(value))
