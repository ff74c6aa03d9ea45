"""Transcript records to ledger turns, one normaliser per tool.

Every normaliser maps ``raw(tool, source_path, start_offset, end_offset, line)`` to the ledger columns plus

* ``status``: ``ok``, ``skipped`` (a record that carries no turn) or ``rejected``; ``reason`` says why,
* ``event_seq``, ``context_session_id``: what the offset table remembers about a source.

Skipped and rejected records keep only their position, never their content.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions import variant as vr
from sessionloom.operators.windows import carry_forward
from sessionloom.schemas import HOUSEKEEPING_TYPES, LEDGER

# Reasons of a rejected record.
CORRUPT = "corrupt json"
NO_SESSION = "missing sessionId"
BAD_TIME = "bad timestamp"
NO_ROLE = "missing role"

NORMALIZED = T.StructType(
    LEDGER.fields
    + [
        T.StructField("status", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("event_seq", T.LongType()),
        T.StructField("context_session_id", T.StringType()),
    ]
)


_POSITION = ["tool", "source_path", "end_offset"]


class Normalizer(Protocol):
    """The plug-in point: any function of this shape can serve a further tool."""

    def __call__(self, raw: DataFrame) -> DataFrame: ...


def finish(rows: DataFrame, keep_when_skipped: tuple[str, ...] = ()) -> DataFrame:
    """Fixed column order; content-bearing columns are blanked unless the record is a turn."""
    always = {"tool", "source_path", "end_offset", "status", "reason", "event_seq", "context_session_id"}
    always |= set(keep_when_skipped)
    columns = []
    for field in NORMALIZED.fields:
        c = F.col(field.name) if field.name in rows.columns else F.lit(None)
        if field.name not in always:
            c = F.when(F.col("status") == "ok", c)
        columns.append(c.cast(field.dataType).alias(field.name))
    return rows.select(*columns)


def _status(skipped: Column, reason: Column) -> Column:
    return F.when(reason.isNotNull(), "rejected").when(skipped, "skipped").otherwise("ok")


def _paths_json(items: Column) -> Column:
    """JSON text of the ``input.path`` strings of tool calls; null if there is none."""
    paths = F.filter(F.transform(items, lambda x: vr.item_string(x, ".input.path")), lambda p: p.isNotNull())
    return F.when(F.size(paths) > 0, F.to_json(paths))


def normalize_claude(raw: DataFrame) -> DataFrame:
    """Records with ``sessionId`` and a ``message`` (or top-level role and content)."""
    v = F.col("v")
    kind = F.coalesce(vr.string_at(v, ".type"), F.lit(""))
    stamp = F.coalesce(vr.get(v, ".timestamp"), vr.get(v, ".ts"))
    named_role = F.coalesce(vr.get(v, ".message.role"), vr.get(v, ".role"))
    parsed = vr.computed_once(
        raw.withColumn("v", vr.parse(F.col("line"))),
        _POSITION,
        corrupt=~vr.well_formed(v),
        housekeeping=kind.isin(*HOUSEKEEPING_TYPES),
        session_id=vr.string_at(v, ".sessionId"),
        undated=stamp.isNull(),
        ts_ms=vr.timestamp_any(stamp),
        role=F.coalesce(vr.as_string(named_role), vr.string_at(v, ".type")),
        body=F.coalesce(vr.get(v, ".message.content"), vr.get(v, ".content")),
        parent_id=vr.string_at(v, ".parentUuid"),
        record_uuid=F.when(vr.well_formed(v), vr.string_at(v, ".uuid")),
    )
    reason = (
        F.when(F.col("corrupt"), CORRUPT)
        .when(F.col("housekeeping"), None)
        .when(F.col("session_id").isNull(), NO_SESSION)
        .when(F.col("undated"), None)
        .when(F.col("ts_ms").isNull(), BAD_TIME)
        .when(F.col("role").isNull(), NO_ROLE)
    )
    used = F.filter(
        F.when(F.startswith(vr.type_of(F.col("body")), F.lit("ARRAY")), vr.as_array(F.col("body"))),
        lambda x: vr.item_string(x, ".type") == "tool_use",
    )
    rows = (
        parsed.withColumn("reason", reason)
        .withColumn("status", _status(F.col("housekeeping") | F.col("undated"), F.col("reason")))
        .withColumn("content", vr.content_text(F.col("body")))
        .withColumn("used", used)
        .withColumn("tool_calls_json", F.when(F.size("used") > 0, F.to_json("used")))
        .withColumn("files_touched_json", _paths_json(F.col("used")))
    )
    return finish(rows, ("record_uuid",))


def _opened_session(v: Column) -> Column:
    """Session id of a ``session_meta`` record; null for any other."""
    return F.when(
        vr.well_formed(v) & (vr.string_at(v, ".type") == "session_meta"),
        F.coalesce(vr.string_at(v, ".payload.id"), vr.string_at(v, ".session_id")),
    )


def opened_session(line: Column) -> Column:
    """The session a line opens; only a line that contains the type's name is parsed."""
    return F.when(F.contains(line.cast("string"), F.lit("session_meta")), _opened_session(vr.parse(line.cast("string"))))


def _first_line_project() -> Column:
    """The working directory named by a file's first line."""
    v = F.when((F.col("start_offset") == 0) & F.contains("line", F.lit("session_meta")), vr.parse_strict(F.col("line")))
    return F.when(vr.string_at(v, ".type") == "session_meta", F.coalesce(vr.string_at(v, ".payload.cwd"), vr.string_at(v, ".cwd")))


def normalize_codex(raw: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """``event_msg`` records take the session of the latest ``session_meta`` before them in the file.

    A scan with ``SESSION_CONTEXT`` delivers that session with each record. Records from elsewhere get it here by
    ``carry_forward``; if they are only the newer part of their sources, ``offsets`` seeds it per source.
    """
    v = F.col("v")
    kind = F.coalesce(vr.string_at(v, ".type"), F.lit(""))
    said_by = vr.string_at(v, ".payload.type")
    new_role = F.when(said_by == "user_message", "user").when(said_by == "agent_message", "assistant")
    number = vr.timestamp_number(vr.get(v, ".ts"))
    iso = vr.iso_to_ms(vr.string_at(v, ".timestamp"))
    calls = vr.get(v, ".tool_calls")
    old = new_role.isNull()
    known = [c for c in ("context_session_id",) if c in raw.columns]
    parsed = vr.computed_once(
        raw.withColumn("v", vr.parse(F.col("line"))),
        _POSITION + known,
        corrupt=~vr.well_formed(v),
        kind=kind,
        old=old,
        meta_session=_opened_session(v),
        own_session=F.nullif(vr.string_at(v, ".session_id"), F.lit("")),
        role=F.coalesce(new_role, vr.string_at(v, ".role")),
        ts_ms=F.when(old, number).otherwise(F.coalesce(iso, number)),
        content=F.when(old, vr.content_text(vr.get(v, ".content"))).otherwise(
            F.coalesce(vr.string_at(v, ".payload.message"), F.lit(""))
        ),
        calls=F.when(old & F.startswith(vr.type_of(calls), F.lit("ARRAY")), vr.as_array(calls)),
        event_seq=F.when(vr.well_formed(v) & (kind == "event_msg"), vr.long_at(v, ".seq")),
        project_dir=_first_line_project() if "start_offset" in raw.columns else F.lit(None).cast("string"),
    )
    if "context_session_id" in raw.columns:
        rows = parsed
    else:
        # Only a line that contains the type's name can open a session; the others need no parsing for the summary.
        marks = raw.select("source_path", "end_offset", opened_session(F.col("line")).alias("value"))
        rows = carry_forward(
            parsed, "source_path", "end_offset", F.col("meta_session"), "context_session_id", marks=marks
        )
    if offsets is not None:
        seed = offsets.select("source_path", F.col("last_session_id").alias("seed"))
        rows = rows.join(seed, "source_path", "left").withColumn(
            "context_session_id", F.coalesce("context_session_id", "seed")
        )
    context = F.nullif(F.col("context_session_id"), F.lit(""))
    rows = rows.withColumn("session_id", F.coalesce("own_session", context))
    empty = ~F.col("old") & (F.col("content") == "")
    usable = (
        (F.col("kind") == "event_msg")
        & F.col("session_id").isNotNull()
        & F.col("ts_ms").isNotNull()
        & F.col("role").isNotNull()
        & ~empty
    )
    rows = (
        rows.withColumn("reason", F.when(F.col("corrupt"), CORRUPT))
        .withColumn("status", _status(~usable, F.col("reason")))
        .withColumn("tool_calls_json", F.when(F.size("calls") > 0, F.to_json("calls")))
        .withColumn("files_touched_json", _paths_json(F.col("calls")))
    )
    return finish(rows, keep_when_skipped=("project_dir",))


def normalize_codex_history(raw: DataFrame) -> DataFrame:
    """Prompt-history lines ``{session_id, ts in seconds, text}`` as user turns."""
    v = F.col("v")
    rows = vr.computed_once(
        raw.withColumn("v", vr.parse(F.col("line"))),
        _POSITION,
        reason=F.when(~vr.well_formed(v), CORRUPT),
        session_id=F.nullif(vr.string_at(v, ".session_id"), F.lit("")),
        ts_ms=F.coalesce(vr.long_at(v, ".ts"), F.lit(0)) * 1000,
        role=F.lit("user"),
        content=F.nullif(vr.string_at(v, ".text"), F.lit("")),
    )
    skipped = F.col("session_id").isNull() | F.col("content").isNull()
    return finish(rows.withColumn("status", _status(skipped, F.col("reason"))))


def normalize_cursor(raw: DataFrame) -> DataFrame:
    """Flat records ``{sessionId, role, content, ts}`` as the key-value readers emit them."""
    v = F.col("v")
    stamp = vr.get(v, ".ts")
    rows = vr.computed_once(
        raw.withColumn("v", vr.parse(F.col("line"))),
        _POSITION,
        corrupt=~vr.well_formed(v),
        session_id=vr.string_at(v, ".sessionId"),
        ts_ms=vr.as_long(stamp),
        role=vr.string_at(v, ".role"),
        content=vr.content_text(vr.get(v, ".content")),
    )
    reason = (
        F.when(F.col("corrupt"), CORRUPT)
        .when(F.col("session_id").isNull(), NO_SESSION)
        .when(F.col("ts_ms").isNull(), BAD_TIME)
        .when(F.col("role").isNull(), NO_ROLE)
    )
    rows = rows.withColumn("reason", reason)
    return finish(rows.withColumn("status", _status(F.lit(False), F.col("reason"))))


NORMALIZERS: dict[str, Normalizer] = {
    "claude": normalize_claude,
    "codex": normalize_codex,
    "codex_history": normalize_codex_history,
    "cursor": normalize_cursor,
}


def turns(normalized: DataFrame) -> DataFrame:
    """Ledger rows of a normalised frame."""
    return normalized.filter("status = 'ok'").select(*LEDGER.fieldNames())


def rejects(normalized: DataFrame) -> DataFrame:
    """Positions and reasons, never payloads."""
    return normalized.filter("status = 'rejected'").select("tool", "source_path", "end_offset", "reason")


def fail_on_reject(normalized: DataFrame) -> DataFrame:
    """Strict mode (Q5): the first rejected record fails the job with its position and reason."""
    message = F.concat_ws(" ", F.col("reason"), F.lit("at byte"), F.col("end_offset").cast("string"))
    checked = F.when(F.col("status") == "rejected", F.raise_error(message)).otherwise(F.col("status"))
    return normalized.withColumn("status", checked.cast("string"))


def drop_history_duplicates(ledger: DataFrame) -> DataFrame:
    """Optional (Q10): keep the first of equal ``(session, role, content)`` turns."""
    order = F.struct("ts_ms", "source_path", "end_offset")
    others = [c for c in ledger.columns if c not in ("session_id", "role", "content")]
    first = F.min_by(F.struct(*others), order)
    return (
        ledger.groupBy("session_id", "role", "content").agg(first.alias("r")).select(
            *[F.col(f"r.{c}").alias(c) if c in others else F.col(c) for c in ledger.columns]
        )
    )


def file_projects(raw: DataFrame) -> DataFrame:
    """The working directory named by the first line of a source, one row per source. No aggregation: a first line starts
    at byte zero."""
    v = F.col("v")
    return (
        raw.filter("start_offset = 0")
        .withColumn("v", vr.parse_strict(F.col("line")))
        .filter(vr.string_at(v, ".type") == "session_meta")
        .select(
            "source_path",
            F.coalesce(vr.string_at(v, ".payload.cwd"), vr.string_at(v, ".cwd")).alias("project_dir"),
        )
    )
