"""Text expressions shared by the distillers.

All of them are built-in column functions, so they stay inside the JVM. Trimming uses an explicit character set instead of
a regular expression: it is linear in the text and agrees with the Unicode White_Space property.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space code points.
BLANKS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ELLIPSIS = "…"

# Words that mark a failed tool run, and phrases that mark another try.
ERROR_WORDS = ("error", "failed", "exception", "traceback", "panic", "sigsegv", "syntaxerror")
RETRY_PHRASES = (
    "retry",
    "tried",
    "didn't work",
    "doesn't work",
    "still failing",
    "let me try",
    "approach 2",
    "next attempt",
)
# Words that announce open work.
MARKERS = ("TODO", "FIXME", "XXX")

FENCE_LINE = r"(?U)(?:(?<=\n)|\A)[^\S\n]*```[^\n]*(?:\n|\z)"
SENTENCE_CUT = r"(?U)(?<=[.!?])(?=\s)"


def trim(c: Column) -> Column:
    """Strip Unicode blanks from both ends (F2)."""
    return F.btrim(c, F.lit(BLANKS))


def rtrim(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def first_line(c: Column) -> Column:
    """First non-blank line, trimmed (F3): what precedes the first newline once leading blanks are gone."""
    return rtrim(F.substring_index(F.ltrim(c, F.lit(BLANKS)), "\n", 1))


def collapse(c: Column) -> Column:
    """Trim and turn every run of blanks into one space."""
    return F.regexp_replace(trim(c), r"(?U)\s+", " ")


def truncate_at_word(c: Column, limit: int) -> Column:
    """At most ``limit`` code points, cut at the last blank of the prefix, then an ellipsis (F1)."""
    prefix = F.substring(c, 1, limit)
    at_blank = rtrim(F.regexp_extract(prefix, r"(?Us)^(.*)\s", 1))
    cut = F.when(prefix.rlike(r"(?U)\s"), at_blank).otherwise(prefix)
    return F.when(F.char_length(c) <= limit, c).otherwise(F.concat(cut, F.lit(ELLIPSIS)))


def hard_truncate(c: Column, limit: int, suffix: str = "") -> Column:
    """First ``limit`` code points, with ``suffix`` only if something was cut."""
    short = F.substring(c, 1, limit)
    return F.when(F.char_length(c) <= limit, c).otherwise(F.concat(short, F.lit(suffix)))


def strip_code_fences(c: Column) -> Column:
    """Drop fenced blocks and fence lines; an unclosed tail stays.

    Splitting on fence lines leaves the text outside fences at even positions and the fenced text at odd ones; a last piece
    at an odd position is an unclosed fence. Linear, and free of the deep recursion a repeated regex group would need.
    """
    unix = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    pieces = F.split(unix, FENCE_LINE)
    kept = F.array_join(F.filter(pieces, lambda x, i: (i % 2 == 0) | (i == F.size(pieces) - 1)), "")
    return trim(F.when(F.contains(c, F.lit("```")), kept).otherwise(unix))


def lines(c: Column) -> Column:
    """Array of lines without line ends (a carriage return before the newline goes too)."""
    return F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n")


def question_sentences(line: Column) -> Column:
    """Sentences of a line that end with a question mark."""
    cut = F.transform(F.split(line, SENTENCE_CUT), trim)
    asked = F.filter(cut, lambda s: F.endswith(s, F.lit("?")))
    return F.when(F.contains(line, F.lit("?")), asked).otherwise(F.array().cast("array<string>"))


def marker_capture(line: Column, marker: str) -> Column:
    """Text after the first stand-alone ``marker`` of a line; null if there is none (F8)."""
    pattern = rf"(?s)(?<![A-Za-z0-9_]){marker}(?![A-Za-z0-9_]):*(.*)\z"
    captured = trim(F.regexp_extract(line, pattern, 1))
    return F.when(F.contains(line, F.lit(marker)), F.nullif(captured, F.lit("")))


def contains_any(lowered: Column, needles: tuple[str, ...]) -> Column:
    """Does the lower-cased text contain one of the needles (F13)?"""
    hit = F.contains(lowered, F.lit(needles[0]))
    for needle in needles[1:]:
        hit = hit | F.contains(lowered, F.lit(needle))
    return hit


def ms_to_iso(ts_ms: Column) -> Column:
    """Epoch milliseconds to second-precision UTC text."""
    return F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def format_age(seconds: Column) -> Column:
    """``42s ago`` / ``7m ago`` / ``3h ago``."""
    secs = seconds.cast("bigint")
    return (
        F.when(secs < 60, F.concat(secs.cast("string"), F.lit("s ago")))
        .when(secs < 3600, F.concat(F.floor(secs / 60).cast("string"), F.lit("m ago")))
        .otherwise(F.concat(F.floor(secs / 3600).cast("string"), F.lit("h ago")))
    )


def section(doc: Column, header: str) -> Column:
    """Body of the first ``## header`` section, up to the next ``## `` line (F15); empty if absent."""
    mark = f"## {header}\n"
    found = F.contains(doc, F.lit(mark))
    start = F.char_length(F.substring_index(doc, mark, 1)) + len(mark) + 1
    after = F.substring(F.concat(doc, F.lit("\n## ")), start, F.char_length(doc) + 4)
    return F.when(found, trim(F.substring_index(after, "\n## ", 1))).otherwise(F.lit(""))


def bullet_ts(line: Column) -> Column:
    """Timestamp of a ``- [ts] value`` bullet (F16); null if the line is no bullet."""
    return F.when(F.startswith(line, F.lit("- [")), F.regexp_extract(line, r"\A- \[([^\]]*)", 1))


def bullet_value(line: Column) -> Column:
    """Value of a ``- [ts] value`` bullet (F16)."""
    found = F.startswith(line, F.lit("- [")) & F.contains(line, F.lit("] "))
    return F.when(found, trim(F.regexp_extract(line, r"(?s)\A.*?\] (.*)\z", 1)))
