"""File activity and captured version-control text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as tx

# Directories that do not count as activity, and limits.
IGNORED_NAMES = (
    ".git", "node_modules", "target", "dist", "build", ".next", ".nuxt", "vendor", ".venv", "venv", "__pycache__",
    ".cache", ".omc", ".claude", ".vscode", ".idea", ".DS_Store",
)
RECENT_HOURS = 6
MAX_DEPTH = 6
MAX_ACTIVITY_FILES = 15
MAX_GIT_CHARS = 200
NO_GIT_CONTEXT = "<no git context>"


def recent_activity(
    files: DataFrame, as_of: Column, limit: int = MAX_ACTIVITY_FILES, extra_ignored: tuple[str, ...] = ()
) -> DataFrame:
    """A10: newest files of ``files(project, path, mtime)`` touched in the last six hours; ``path`` is relative to the project.

    ``extra_ignored`` adds names such as the folder the digests themselves are written to.
    """
    names = F.split("path", "/")
    ignored = F.array(*[F.lit(n) for n in IGNORED_NAMES + extra_ignored])
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    now, touched = micros(as_of), micros(F.col("mtime"))
    age = F.floor((now - touched) / 1_000_000)
    shown = F.when(age < 0, F.lit("just now")).otherwise(tx.format_age(age))
    w = Window.partitionBy("project").orderBy(F.desc("mtime"), F.asc("path"))
    return (
        files.filter(touched >= now - RECENT_HOURS * 3_600_000_000)
        .filter(~F.arrays_overlap(names, ignored) & (F.size(names) <= MAX_DEPTH + 1))
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= limit)
        .select("project", "rank", F.concat(F.lit("- "), F.col("path"), F.lit(" ("), shown, F.lit(")")).alias("line"))
    )


def git_context(head: Column, diffstat: Column) -> Column:
    """Short commit id and the last line of a captured diff statistic."""
    summary = tx.trim(F.substring_index(tx.trim(diffstat), "\n", -1))
    told = F.concat(F.lit("HEAD: "), F.substring(head, 1, 8))
    told = F.when(F.nullif(tx.trim(diffstat), F.lit("")).isNull(), told).otherwise(
        F.concat(told, F.lit("; diff: "), summary)
    )
    return F.when(F.nullif(head, F.lit("")).isNull(), F.lit(NO_GIT_CONTEXT)).otherwise(
        tx.hard_truncate(told, MAX_GIT_CHARS, tx.ELLIPSIS)
    )


def diffstat_lines(captured: DataFrame, key: str, text: str) -> DataFrame:
    """Readable lines of a captured diff statistic, one document per key.

    The list ends with the first line, other than a summary, at which sixteen lines are shown. All of it happens within a row.
    """
    stripped = F.filter(F.transform(tx.lines(F.col(text)), tx.trim), lambda x: x != "")
    told = lambda c: c["summary"] | c["per_file"]
    rows = (
        captured.withColumn("__lines", stripped)
        .withColumn(
            "__lines",
            F.transform(
                "__lines",
                lambda x, i: F.struct(
                    i.alias("pos"),
                    x.alias("line"),
                    (F.contains(x, F.lit(" file")) & F.contains(x, F.lit(" changed"))).alias("summary"),
                    F.contains(x, F.lit("|")).alias("per_file"),
                ),
            ),
        )
        .withColumn("__told", F.filter("__lines", told))
        .withColumn("__full", F.get("__told", F.lit(MAX_ACTIVITY_FILES))["pos"])
        .withColumn(
            "__stop",
            F.get(F.filter("__lines", lambda c: (c["pos"] >= F.col("__full")) & ~c["summary"]), F.lit(0))["pos"],
        )
    )
    shown = F.filter("__told", lambda c: F.col("__stop").isNull() | (c["pos"] <= F.col("__stop")))
    line = F.col("c.line")
    stats = tx.trim(F.regexp_extract(line, r"(?s)\A[^|]*\|(.*)\z", 1))
    count = lambda ch: F.length("stats") - F.length(F.replace("stats", F.lit(ch), F.lit("")))
    first = F.nullif(F.regexp_extract("stats", r"(?U)\A(\S+)", 1), F.lit(""))
    path = tx.trim(F.substring_index(line, "|", 1))
    described = F.when(F.col("c.summary"), F.concat(F.lit("Summary: "), line)).otherwise(
        F.concat(
            F.lit("- "), path, F.lit(": "), F.coalesce(first, F.lit("?")), F.lit(" lines (+"),
            count("+").cast("string"), F.lit(" -"), count("-").cast("string"), F.lit(")"),
        )
    )
    return (
        rows.select(key, F.posexplode(shown).alias("i", "c"))
        .withColumn("stats", stats)
        .select(key, (F.col("i") + 1).cast("bigint").alias("rank"), described.alias("text"))
    )
