"""Offsets and incremental reads.

The offset table is an append-only log: a source's state is the maximum of what was logged for it. Offsets never move back, so
appending in any order, twice or after a lost executor gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.sizes import broadcast_if_small
from sessionloom.schemas import OFFSETS

_SOURCE = ["tool", "source_path"]


def current_offsets(log: DataFrame) -> DataFrame:
    """S10 load: latest state per source. A null never overwrites a known value."""
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("byte_offset")))
    return log.groupBy(*_SOURCE).agg(
        F.max("byte_offset").alias("byte_offset"),
        F.max("last_event_seq").alias("last_event_seq"),
        latest("last_uuid").alias("last_uuid"),
        latest("last_session_id").alias("last_session_id"),
        latest("project_dir").alias("project_dir"),
    )


def advance_offsets(records: DataFrame) -> DataFrame:
    """What a batch of normalised records adds to the offset log; partial aggregation only."""
    def at_end(c: str):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("end_offset")))

    return records.groupBy(*_SOURCE).agg(
        F.max("end_offset").alias("byte_offset"),
        F.max("event_seq").alias("last_event_seq"),
        at_end("record_uuid").alias("last_uuid"),
        at_end("context_session_id").alias("last_session_id"),
        at_end("project_dir").alias("project_dir"),
    ).select(*OFFSETS.fieldNames())


def read_since(raw: DataFrame, offsets: DataFrame, key: str | list[str] = "source_path") -> DataFrame:
    """Records past the stored offset of their source."""
    keys = [key] if isinstance(key, str) else key
    known = offsets.select(*keys, "byte_offset")
    return (
        raw.join(known, keys, "left")
        .filter(F.col("end_offset") > F.coalesce("byte_offset", F.lit(0)))
        .drop("byte_offset")
    )


def merge_offsets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Monotonic merge of two offset tables; new non-null fields win, the offset never regresses."""
    return current_offsets(old.unionByName(new, allowMissingColumns=True))


def not_yet_stored(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Records whose position is not in the table yet, so a repeated batch or a rescan adds nothing."""
    return batch.join(stored.select("source_path", "end_offset"), ["source_path", "end_offset"], "left_anti")


def known_projects(offsets: DataFrame) -> DataFrame:
    """A13."""
    return offsets.filter("project_dir is not null").select("project_dir", "tool").distinct()


def after_last_id(messages: DataFrame, watermarks: DataFrame, key: str = "source_key") -> DataFrame:
    """Messages whose id sorts after the stored id of their key."""
    known = broadcast_if_small(watermarks.select(key, "last_msg_id"))
    return messages.join(known, key, "left").filter(F.col("msg_id") > F.coalesce("last_msg_id", F.lit(""))).drop(
        "last_msg_id"
    )


def last_ids(messages: DataFrame, key: str = "source_key") -> DataFrame:
    return messages.groupBy(key).agg(F.max("msg_id").alias("last_msg_id"))
