"""Table layouts and the fixed vocabulary of the transcript tools."""

from __future__ import annotations

from pyspark.sql import types as T

TOOLS = ("claude", "cursor", "codex")

# Transcript record types that are bookkeeping, not conversation.
HOUSEKEEPING_TYPES = ("file-history-snapshot", "permission-mode", "queue-operation", "summary")

RAW = T.StructType(
    [
        T.StructField("tool", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("start_offset", T.LongType()),
        T.StructField("end_offset", T.LongType()),
        T.StructField("line", T.StringType()),
        T.StructField("is_complete", T.BooleanType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tool_calls_json", T.StringType()),
        T.StructField("files_touched_json", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("record_uuid", T.StringType()),
        T.StructField("project_dir", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("end_offset", T.LongType()),
    ]
)

OFFSETS = T.StructType(
    [
        T.StructField("tool", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("byte_offset", T.LongType()),
        T.StructField("last_event_seq", T.LongType()),
        T.StructField("last_uuid", T.StringType()),
        T.StructField("last_session_id", T.StringType()),
        T.StructField("project_dir", T.StringType()),
    ]
)

HOOK_EVENTS = T.StructType(
    [
        T.StructField("tool", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("transcript_path", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("cwd", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts", T.TimestampType()),
    ]
)
