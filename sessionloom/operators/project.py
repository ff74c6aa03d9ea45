"""The document of a project (A11, A12): accumulated history, file activity, version-control context and progress log around its newest digest.

A document shows at most ``MAX_DIGEST_LINES`` lines, so no more than that are gathered for a project: each kind of line is ranked and cut before it is
shuffled to the others. The progress file holds the whole log; its lines stay rows from the log to the writer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as tx
from sessionloom.operators import progress
from sessionloom.operators.digest import CUT_LINE, MAX_DIGEST_LINES, NO_GIT_CONTEXT

_FIRST, _LAST = -1, 1 << 62


def newest_digests(digests: DataFrame) -> DataFrame:
    """The digest of each project's newest session, of ``digests`` with ``project``."""
    others = [c for c in digests.columns if c != "project"]
    newest = F.max_by(F.struct(*others), F.struct("timestamp_iso", "session_id"))
    return digests.where("project is not null").groupBy("project").agg(newest.alias("d")).select("project", "d.*")


def _rows(df: DataFrame, section: int, pos: Column | int, line: Column | str) -> DataFrame:
    pos = F.lit(pos) if isinstance(pos, int) else pos
    line = F.lit(line) if isinstance(line, str) else line
    return df.select("project", F.lit(section).alias("section"), pos.cast("bigint").alias("pos"), line.alias("line"))


def _ranked(log: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("project").orderBy("ord", "entry")
    return log.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def document_lines(latest: DataFrame, history: DataFrame, log: DataFrame, activity: DataFrame | None = None, git: DataFrame | None = None) -> DataFrame:
    """``(project, section, pos, line)``: lines of the documents, each section cut where a document ends at the latest.

    ``latest``: ``newest_digests``; ``history(project, section, value, first_seen_ms)``; ``log(project, entry, ord)``; ``activity(project, rank, line)``;
    ``git(project, git_context)``. Only projects of ``latest`` have a document.
    """
    there = latest.select("project")
    title = F.concat(F.lit("# Last updated "), F.col("timestamp_iso"), F.lit(" from "), F.col("source_tool"))
    parts = [_rows(latest, 0, 0, title), _rows(latest, 0, 1, "")]

    def block(section: int, name: str, body: DataFrame, owners: DataFrame) -> None:
        parts.extend([_rows(owners, section, _FIRST, f"## {name}"), body, _rows(owners, section, _LAST, "")])

    bullets = progress.newest_history(history, MAX_DIGEST_LINES).join(there, "project", "left_semi")
    for section, name, title in ((1, "task", "Task"), (6, "next_action", "Next action")):
        mine = bullets.where(F.col("section") == name)
        nothing = there.join(mine.select("project"), "project", "left_anti")
        block(section, title, _rows(mine, section, F.col("rank"), F.col("bullet")).unionByName(_rows(nothing, section, 0, "")), there)
    if activity is not None:
        mine = activity.join(there, "project", "left_semi").where(F.col("rank") <= MAX_DIGEST_LINES)
        block(2, "Session activity", _rows(mine, 2, F.col("rank"), F.col("line")), mine.select("project").distinct())
    for section, column, title in ((3, "recent_files", "Recent files"), (4, "failed_approaches", "Failed approaches"), (5, "open_questions", "Open questions")):
        items = latest.select("project", F.posexplode(column).alias("at", "item"))
        block(section, title, _rows(items, section, F.col("at"), F.concat(F.lit("- "), F.col("item"))), latest.where(F.size(column) > 0))
    if git is not None:
        mine = git.join(there, "project", "left_semi").where(F.coalesce("git_context", F.lit("")).isin("", NO_GIT_CONTEXT) == F.lit(False))
        block(7, "Git context", _rows(mine, 7, 0, F.col("git_context")), mine)
    entries = _ranked(log.join(there, "project", "left_semi"), MAX_DIGEST_LINES)
    body = _rows(entries, 8, F.col("rank") + 1, F.col("entry"))
    for df in _frame(latest):
        body = body.unionByName(_rows(df, 8, F.col("pos"), F.col("line")))
    block(8, "Progress log", body, there)
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines


def _frame(latest: DataFrame) -> list[DataFrame]:
    """``(project, pos, line)`` around the entries of a progress log."""
    mark = F.concat(F.lit("<!-- session: "), F.col("session_id"), F.lit(" -->"))
    head = latest.select("project", F.posexplode(F.array(mark, F.lit("# Progress Log"))).alias("pos", "line"))
    foot = F.concat(F.array(F.lit(""), F.lit("## What to do next")), tx.lines(tx.trim(F.col("next_action"))))
    after = latest.select("project", F.posexplode(foot).alias("pos", "line")).withColumn("pos", F.col("pos") + F.lit(1 << 61))
    return [head, after]


def render_documents(lines: DataFrame) -> DataFrame:
    """``(project, body)``: the lines in order, cut at ``MAX_DIGEST_LINES``, with a newline at the end."""
    w = Window.partitionBy("project").orderBy("section", "pos")
    shown = lines.withColumn("n", F.row_number().over(w)).where(F.col("n") <= MAX_DIGEST_LINES + 1)
    some = shown.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))  # one more than are shown at most
    all_ = F.transform("l", lambda x: x["line"])
    cut = F.when(F.size("l") > MAX_DIGEST_LINES, F.concat(F.slice(all_, 1, MAX_DIGEST_LINES - 1), F.array(F.lit(CUT_LINE)))).otherwise(all_)
    body = F.array_join(cut, "\n")
    return some.select("project", F.when(F.endswith(body, F.lit("\n")), body).otherwise(F.concat(body, F.lit("\n"))).alias("body"))


def progress_file_lines(latest: DataFrame, log: DataFrame) -> DataFrame:
    """``(project, part, pos, ord, line)``: every line of the progress files, in the order of part, pos, ord and line. Nothing is gathered."""
    head, foot = _frame(latest)
    kind = log.schema["ord"].dataType
    none = F.lit(None).cast(kind)
    entries = log.join(latest.select("project"), "project", "left_semi").select("project", F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("pos"), "ord", F.col("entry").alias("line"))
    around = [df.select("project", F.lit(part).alias("part"), F.col("pos").cast("bigint").alias("pos"), none.alias("ord"), "line") for part, df in ((0, head), (2, foot))]
    return around[0].unionByName(entries).unionByName(around[1])
