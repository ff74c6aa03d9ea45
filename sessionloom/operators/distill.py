"""Per-session distillers.

One scan of the ledger turns every turn into a few small *candidates* ``(kind, key, value, position)``. Distinct candidates are
counted once by a hash-partitioned aggregation with map-side combine, the first or last few per session survive a ranked window
(Spark limits the ranks before the shuffle), and only those survivors are collected. No task ever holds a whole session, so one
session may own any share of the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as tx
from sessionloom.functions import variant as vr

# Limits and placeholder texts of a digest.
MAX_TASK_CHARS = 120
MAX_NEXT_ACTION_CHARS = 2000
MAX_BULLET_CHARS = 80
MAX_ENTRY_CHARS = 150
MIN_PROMPT_BYTES = 10
NO_TASK = "<no task captured>"
NO_NEXT_ACTION = "<no next action captured>"


@dataclass(frozen=True)
class Kind:
    name: str
    limit: int | None  # None: all of them, without a rank
    newest_first: bool = False


QUESTION = Kind("question", 5)
FAILED = Kind("failed", 3)
FILE = Kind("file", 10, newest_first=True)
ENTRY = Kind("entry", None)
TASK = Kind("task", 1)
ANSWER = Kind("answer", 1, newest_first=True)
ASK = Kind("ask", 1, newest_first=True)
CODING = Kind("coding", 1)
SESSION = Kind("session", 1, newest_first=True)
ALL_KINDS = (QUESTION, FAILED, FILE, ENTRY, TASK, ANSWER, ASK, CODING, SESSION)

_CANDIDATE = "array<struct<kind:string,key:string,value:string,line:int,item:int>>"


def turn_order(df: DataFrame) -> Column:
    """Total order of the turns of a session: time, then where the turn was read from."""
    return F.struct(*[F.col(c) for c in ("ts_ms", "source_path", "end_offset") if c in df.columns])


def annotate(ledger: DataFrame) -> DataFrame:
    """Adds ``ord``, ``body``, ``said`` (F6, P22) and ``head``, each in its own projection so that it is computed once per turn.

    ``body`` is the trimmed content. ``said`` is the readable text: plain text of users and assistants, the text blocks of an
    assistant's array, else null. ``head`` is the first visible line of ``said``, null if there is none.
    """
    role, body = F.col("role"), F.col("body")
    plain = ~F.startswith(body, F.lit("["))
    said = F.when(
        role.isin("user", "assistant") & (body != ""), F.when(plain, body).when(role == "assistant", vr.text_blocks(body))
    )
    return (
        ledger.withColumn("ord", turn_order(ledger))
        .withColumn("body", tx.trim(F.col("content")))
        .withColumn("said", said)
        .withColumn("head", F.nullif(tx.first_line(F.col("said")), F.lit("")))
    )


def is_substantial_prompt() -> Column:
    """P23, on annotated turns: a user's own text of at least ten bytes."""
    return (F.col("role") == "user") & (F.octet_length("said") >= MIN_PROMPT_BYTES)


def task_text() -> Column:
    return tx.truncate_at_word(F.col("head"), MAX_TASK_CHARS)


def with_answer(turns: DataFrame) -> DataFrame:
    """Adds ``answer``: what an assistant turn says outside code fences; null if nothing."""
    outside = F.when(F.col("role") == "assistant", tx.strip_code_fences(F.col("said")))
    return turns.withColumn("outside", F.nullif(outside, F.lit(""))).withColumn(
        "answer", tx.truncate_at_word(F.col("outside"), MAX_NEXT_ACTION_CHARS)
    )


def ask_text() -> Column:
    return F.concat(F.lit("Continue: "), tx.truncate_at_word(F.col("head"), MAX_NEXT_ACTION_CHARS - 10))


def entry_text() -> Column:
    """Progress line of a prose turn (A6); null if the turn has no visible text."""
    stamp = tx.ms_to_iso(F.col("ts_ms"))
    shown = tx.truncate_at_word(F.col("head"), MAX_ENTRY_CHARS)
    return F.concat(F.lit("- ["), stamp, F.lit("] ["), F.col("role"), F.lit("] "), shown)


def is_failed_turn(error_roles: tuple[str, ...] = ("tool_result",)) -> Column:
    """On turns with a ``low`` column, the lower-cased content."""
    role, low = F.col("role"), F.col("low")
    failed = role.isin(*error_roles) & tx.contains_any(low, tx.ERROR_WORDS)
    return failed | ((role == "assistant") & tx.contains_any(low, tx.RETRY_PHRASES))


def _candidate(kind: Kind, key: Column, value: Column, line: Column | int = 0, item: Column | int = 0) -> Column:
    number = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
    return F.struct(
        F.lit(kind.name).alias("kind"),
        key.cast("string").alias("key"),
        value.cast("string").alias("value"),
        number(line).alias("line"),
        number(item).alias("item"),
    )


def _question_candidates(said: Column) -> Column:
    """Markers first, then question sentences, line by line."""
    none = F.lit(None).cast("string")

    def of_line(line: Column, i: Column) -> Column:
        marked = [
            _candidate(QUESTION, tx.collapse(tx.marker_capture(line, m)), none, i, j) for j, m in enumerate(tx.MARKERS)
        ]
        asked = F.transform(
            tx.question_sentences(line),
            lambda s, j: _candidate(QUESTION, tx.collapse(s), none, i, j + len(tx.MARKERS)),
        )
        return F.concat(F.array(*marked), asked)

    found = F.flatten(F.transform(tx.lines(said), of_line))
    has_any = F.contains(said, F.lit("?"))
    for m in tx.MARKERS:
        has_any = has_any | F.contains(said, F.lit(m))
    return F.when(has_any, F.filter(found, lambda c: c["key"] != ""))


def candidates(
    ledger: DataFrame,
    kinds: tuple[Kind, ...],
    error_roles: tuple[str, ...] = ("tool_result",),
    session: str = "session_id",
) -> DataFrame:
    """Candidates of the wanted kinds, one row each, with their position in the session."""
    role, said = F.col("role"), F.col("said")
    none = F.lit(None).cast("string")
    blank = F.lit("")

    def single(kind: Kind, condition: Column, key: Column, value: Column) -> Column:
        return F.when(condition, F.array(_candidate(kind, key, value)))

    made = {
        QUESTION: lambda: _question_candidates(said),
        FAILED: lambda: single(
            FAILED, is_failed_turn(error_roles), tx.collapse(F.substring_index("body", "\n", 1)), none
        ),
        FILE: lambda: F.transform(
            vr.string_array(F.col("files_touched_json")), lambda p: _candidate(FILE, p, none)
        ),
        ENTRY: lambda: single(ENTRY, F.col("head").isNotNull() & role.isNotNull(), entry_text(), none),
        TASK: lambda: single(TASK, is_substantial_prompt(), blank, task_text()),
        ANSWER: lambda: single(ANSWER, F.col("answer").isNotNull(), blank, F.col("answer")),
        ASK: lambda: single(ASK, (role == "user") & said.isNotNull(), blank, ask_text()),
        CODING: lambda: single(CODING, F.col("tool_calls_json").isNotNull(), blank, none),
        SESSION: lambda: single(SESSION, F.lit(True), blank, F.col("tool")),
    }
    turns = annotate(ledger)
    if FAILED in kinds:
        turns = turns.withColumn("low", F.when(role.isin("assistant", *error_roles), F.lower("content")))
    if ANSWER in kinds:
        turns = with_answer(turns)
    empty = F.array().cast(_CANDIDATE)
    parts = [F.coalesce(made[k]().cast(_CANDIDATE), empty) for k in kinds]
    everything = parts[0] if len(parts) == 1 else F.concat(*parts)
    return turns.select(F.col(session).alias("session_id"), "ord", F.explode(everything).alias("c")).select(
        "session_id", "c.kind", "c.key", "c.value", F.struct("ord", "c.line", "c.item").alias("pos")
    )


def best(found: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """Distinct candidates of each session, best ranks only: the candidate columns plus ``rank``.

    Mergeable: the best of several bests together equals the best of everything, because a candidate that was cut off can only
    come back through an occurrence that ranks by itself. So the result can be kept as the state of a session.
    """
    newest = [k.name for k in kinds if k.newest_first]
    is_newest = F.col("kind").isin(*newest) if newest else F.lit(False)
    both = F.struct("pos", "value")
    distinct = found.groupBy("session_id", "kind", "key").agg(
        F.min(F.when(~is_newest, both)).alias("first"), F.max(F.when(is_newest, both)).alias("last")
    )
    every = [k.name for k in kinds if k.limit is None]
    # Kinds without a limit are told apart by their key, so that no window holds a session's whole log.
    apart = [F.when(F.col("kind").isin(*every), F.col("key"))] if every else []
    w = Window.partitionBy("session_id", "kind", *apart).orderBy(
        F.col("first.pos").asc(), F.col("last.pos").desc(), F.col("key").asc()
    )
    limits = sorted({k.limit or 1 for k in kinds})
    ranked = distinct.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limits[-1])
    for limit in limits[:-1]:
        ranked = ranked.filter(
            ~F.col("kind").isin(*[k.name for k in kinds if (k.limit or 1) == limit]) | (F.col("rank") <= limit)
        )
    kept = F.coalesce("first", "last")
    return ranked.select("session_id", "kind", "key", kept["value"].alias("value"), kept["pos"].alias("pos"), "rank")


def rank(found: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """``session_id, kind, rank, text, pos`` of the best candidates."""
    text = F.coalesce("value", F.nullif(F.col("key"), F.lit("")))
    bullets = F.col("kind").isin(QUESTION.name, FAILED.name)
    return best(found, kinds).withColumn("text", text).select(
        "session_id",
        "kind",
        "rank",
        F.when(bullets, tx.truncate_at_word(F.col("text"), MAX_BULLET_CHARS)).otherwise(F.col("text")).alias("text"),
        "pos",
    )


def task(ledger: DataFrame) -> DataFrame:
    """A1: first substantial prompt of every session, one line."""
    turns = annotate(ledger).select("session_id", "ord", F.when(is_substantial_prompt(), task_text()).alias("text"))
    first = F.min_by("text", F.when(F.col("text").isNotNull(), F.col("ord")))
    return turns.groupBy("session_id").agg(F.coalesce(first, F.lit(NO_TASK)).alias("task"))


def next_action(ledger: DataFrame) -> DataFrame:
    """A2: what the last assistant turn says outside code fences, else the last prompt."""
    ask = F.when((F.col("role") == "user") & F.col("said").isNotNull(), ask_text())
    turns = with_answer(annotate(ledger)).select("session_id", "ord", "answer", ask.alias("ask"))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    return turns.groupBy("session_id").agg(
        F.coalesce(latest("answer"), latest("ask"), F.lit(NO_NEXT_ACTION)).alias("next_action")
    )


def open_questions(ledger: DataFrame) -> DataFrame:
    """A3: first five distinct open questions of a session."""
    return rank(candidates(ledger, (QUESTION,)), (QUESTION,)).select("session_id", "rank", F.col("text").alias("bullet"))


def recent_files(ledger: DataFrame) -> DataFrame:
    """A4: ten most recently touched files of a session; ties by path."""
    return rank(candidates(ledger, (FILE,)), (FILE,)).select("session_id", "rank", F.col("text").alias("path"))


def coding_sessions(ledger: DataFrame) -> DataFrame:
    """Sessions in which some turn called a tool, and in which some turn called a tool or touched a file."""
    return ledger.groupBy("session_id").agg(
        F.bool_or(F.col("tool_calls_json").isNotNull()).alias("has_tool_calls"),
        F.bool_or(F.col("tool_calls_json").isNotNull() | F.col("files_touched_json").isNotNull()).alias("is_coding"),
    )


def failed_approaches(ledger: DataFrame, error_roles: tuple[str, ...] = ("tool_result",)) -> DataFrame:
    """A5: first three distinct failures of a coding session. The guard joins after the top three are known, so it is small."""
    best = rank(candidates(ledger, (FAILED,), error_roles), (FAILED,))
    coding = coding_sessions(ledger).filter("has_tool_calls").select("session_id")
    return best.join(coding, "session_id", "left_semi").select("session_id", "rank", F.col("text").alias("bullet"))


def progress_entries(ledger: DataFrame) -> DataFrame:
    """One progress line per prose turn; a projection without shuffle."""
    wanted = ("session_id", "ts_ms", "source_path", "end_offset", "role", "project", "project_dir")
    kept = [c for c in wanted if c in ledger.columns]
    # Exploding drops the turns without an entry and computes each entry once; a filter would compute it again.
    entry = F.filter(F.array(entry_text()), lambda e: e.isNotNull())
    return annotate(ledger).select(*kept, F.explode(entry).alias("entry"))
