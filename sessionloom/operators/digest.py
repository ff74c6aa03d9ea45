"""Session digest: assembly (A11) and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import text as tx
from sessionloom.operators import distill as ds

# Fixed values of the rendered document.
MAX_DIGEST_LINES = 150
CUT_LINE = "…(truncated)"
NO_GIT_CONTEXT = "<no git context>"


def session_digest(
    ledger: DataFrame, error_roles: tuple[str, ...] = ("tool_result",), session: str = "session_id"
) -> DataFrame:
    """One row per session with every distilled field, from one scan of the ledger.

    Three exchanges, none of them on whole turns: distinct candidates, ranks per session and kind, the survivors per session.
    The progress entries are all there, so a row is as long as its session's log; ``progress_entries`` has them as rows.
    """
    return assemble(ds.candidates(ledger, ds.ALL_KINDS, error_roles, session))


def session_state(ledger: DataFrame, error_roles: tuple[str, ...] = ("tool_result",)) -> DataFrame:
    """What a batch of turns adds to the state of its sessions: the progress entries and a bounded number of short candidates each, no contents.

    The union of a session's states goes into ``assemble`` in place of its turns.
    """
    return ds.best(ds.candidates(ledger, ds.ALL_KINDS, error_roles), ds.ALL_KINDS).drop("rank")


def merged_state(rows: DataFrame) -> DataFrame:
    """One state per session out of several: the best of their candidates."""
    return ds.best(rows, ds.ALL_KINDS).drop("rank").select(*rows.columns)


def assemble(found: DataFrame) -> DataFrame:
    """Digest rows from the candidates, or the collected states, of sessions."""
    best = ds.rank(found, ds.ALL_KINDS)

    def one(kind: ds.Kind, value: Column) -> Column:
        return F.max(F.when(F.col("kind") == kind.name, value))

    def many(kind: ds.Kind) -> Column:
        place = "pos" if kind.limit is None else "rank"
        picked = F.collect_list(F.when(F.col("kind") == kind.name, F.struct(place, "text")))
        return F.transform(F.array_sort(picked), lambda x: x["text"])

    coding = F.coalesce(F.bool_or(F.col("kind") == ds.CODING.name), F.lit(False))
    nothing = F.array().cast("array<string>")
    return best.groupBy("session_id").agg(
        one(ds.SESSION, F.col("text")).alias("source_tool"),
        tx.ms_to_iso(one(ds.SESSION, F.col("pos.ord.ts_ms"))).alias("timestamp_iso"),
        F.coalesce(one(ds.TASK, F.col("text")), F.lit(ds.NO_TASK)).alias("task"),
        F.coalesce(
            one(ds.ANSWER, F.col("text")), one(ds.ASK, F.col("text")), F.lit(ds.NO_NEXT_ACTION)
        ).alias("next_action"),
        many(ds.QUESTION).alias("open_questions"),
        many(ds.FILE).alias("recent_files"),
        F.when(coding, many(ds.FAILED)).otherwise(nothing).alias("failed_approaches"),
        many(ds.ENTRY).alias("progress_entries"),
    )


def history_bullet(timestamp_iso: Column, value: Column) -> Column:
    """Section body holding one dated value; empty for placeholders (A8 on an empty history)."""
    line = tx.first_line(value)
    skip = (line == "") | F.startswith(line, F.lit("<no "))
    return F.when(skip, F.lit("")).otherwise(F.concat(F.lit("- ["), timestamp_iso, F.lit("] "), line))


def progress_lines(session_id: Column, entries: Column, next_action: Column) -> Column:
    """Lines of the progress section: watermark, title, entries, footer."""
    return F.concat(
        F.array(F.concat(F.lit("<!-- session: "), session_id, F.lit(" -->")), F.lit("# Progress Log")),
        entries,
        F.array(F.lit(""), F.lit("## What to do next")),
        tx.lines(tx.trim(next_action)),
    )


def render_digest(digest: DataFrame) -> DataFrame:
    """``session_id, body`` of the rendered documents."""
    return with_body(digest).select("session_id", "body")


def with_body(digest: DataFrame) -> DataFrame:
    """Adds the rendered ``body``: fixed section order, empty list sections left out, at most 150 lines.

    Optional columns: ``session_activity`` (array), ``git_context``.
    """

    def block(title: str, body: Column) -> Column:
        return F.concat(F.array(F.lit(f"## {title}")), body, F.array(F.lit("")))

    def listed(title: str, column: str, prefix: str = "- ") -> Column:
        items = F.transform(F.col(column), lambda x: F.concat(F.lit(prefix), x))
        return F.when(F.size(column) > 0, block(title, items)).otherwise(F.array().cast("array<string>"))

    stamp = F.col("timestamp_iso")
    title = F.concat(F.lit("# Last updated "), stamp, F.lit(" from "), F.col("source_tool"))
    parts = [F.array(title, F.lit("")), block("Task", F.array(history_bullet(stamp, F.col("task"))))]
    if "session_activity" in digest.columns:
        parts.append(listed("Session activity", "session_activity", ""))
    parts += [
        listed("Recent files", "recent_files"),
        listed("Failed approaches", "failed_approaches"),
        listed("Open questions", "open_questions"),
        block("Next action", F.array(history_bullet(stamp, F.col("next_action")))),
    ]
    if "git_context" in digest.columns:
        git = F.coalesce(F.col("git_context"), F.lit(""))
        shown = (git != "") & (git != NO_GIT_CONTEXT)
        parts.append(F.when(shown, block("Git context", F.array(git))).otherwise(F.array().cast("array<string>")))
    parts.append(
        block("Progress log", progress_lines(F.col("session_id"), F.col("progress_entries"), F.col("next_action")))
    )
    rows = digest.withColumn("all_lines", F.concat(*parts))
    cut = F.concat(F.slice("all_lines", 1, MAX_DIGEST_LINES - 1), F.array(F.lit(CUT_LINE)))
    shown_lines = F.when(F.size("all_lines") > MAX_DIGEST_LINES, cut).otherwise(F.col("all_lines"))
    body = F.col("body")
    closed = F.when(F.endswith(body, F.lit("\n")), body).otherwise(F.concat(body, F.lit("\n")))
    return rows.withColumn("body", F.array_join(shown_lines, "\n")).withColumn("body", closed).drop("all_lines")
