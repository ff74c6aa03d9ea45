"""End-to-end ingest: records, offsets, digests, progress log and history of one batch.

Each step appends to its table and is safe to repeat with the same batch id: records are matched by position, the progress log
and the history by what they already hold, and digests by batch. A step reads what the step before it wrote, so a batch parses
its input once and a lost executor costs a retry of one job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import activity, digest, distill, incremental, kv, normalize, progress, project
from sessionloom.operators.hooks import resolve_project
from sessionloom.operators.sizes import broadcast_if_small
from sessionloom.session import configure, drop_folder, shared_dir
from sessionloom.sources import documents, jsonl, tail
from sessionloom.sources.tables import Warehouse

NO_PROJECT = "unknown"


def ingest_path(
    warehouse: Warehouse,
    tool: str,
    path: str | list[str],
    batch_id: int,
    *,
    full_refresh: bool = False,
    mode: str = "PERMISSIVE",
    glob: str = "*.jsonl",
    source_kind: str | None = None,
    **options: str,
) -> None:
    """Read what is new below ``path``. Only the bytes past a file's offset are read, where tasks can open files of its store themselves; elsewhere
    Spark reads the files that grew.

    ``full_refresh`` (I8) ignores the offsets; stored positions still keep it idempotent.
    """
    spark = configure(warehouse.spark)
    first = path if isinstance(path, str) else path[0]
    if tail.reachable(tail.qualified(spark, first)) and not options:
        known = None if full_refresh else incremental.current_offsets(warehouse.offset_log().filter(F.col("tool") == tool))
        kind = source_kind or tool
        opened = normalize.opened_session(F.col("line")) if kind == "codex" else None
        raw = tail.read_new(spark, tool, path, known, glob, strict=mode == "FAILFAST" and tool == "codex", opened=opened)
        ingest_raw(warehouse, raw, tool, batch_id, full_refresh=full_refresh, mode=mode, source_kind=source_kind)
        return
    lines = None
    if not full_refresh:
        known = incremental.current_offsets(warehouse.offset_log().filter(F.col("tool") == tool))
        grown = jsonl.grown_sources(spark, path, known, glob)
        lines = jsonl.read_lines(spark, grown, None, **options) if grown else jsonl.read_lines(spark, path, glob, **options).limit(0)
    if lines is None:
        lines = jsonl.read_lines(spark, path, glob, **options)
    ingest_lines(warehouse, lines, tool, batch_id, full_refresh=full_refresh, mode=mode, source_kind=source_kind)


def ingest_lines(
    warehouse: Warehouse,
    lines: DataFrame,
    tool: str,
    batch_id: int,
    *,
    full_refresh: bool = False,
    mode: str = "PERMISSIVE",
    source_kind: str | None = None,
) -> None:
    """Whole files as Spark reads them. ``source_kind`` names the normaliser where it differs from the tool (the prompt history of a tool)."""
    known = warehouse.offset_log().filter(F.col("tool") == tool)
    offsets = broadcast_if_small(incremental.current_offsets(known))
    # An unterminated tail fails a strict read of the tools that write whole records only.
    context = jsonl.SESSION_CONTEXT if (source_kind or tool) == "codex" else None
    raw = jsonl.scan_jsonl(lines, tool, mode if tool == "codex" else "PERMISSIVE", context)
    if not full_refresh:
        raw = incremental.read_since(raw, offsets)
    ingest_raw(warehouse, raw, tool, batch_id, full_refresh=full_refresh, mode=mode, source_kind=source_kind)


def ingest_raw(
    warehouse: Warehouse, raw: DataFrame, tool: str, batch_id: int, *, full_refresh: bool = False, mode: str = "PERMISSIVE", source_kind: str | None = None
) -> None:
    """Records that are new. Those of codex take the session their file had open; without it in ``raw`` it is carried forward here, from the offsets on."""
    kind = source_kind or tool
    if kind == "codex" and "context_session_id" not in raw.columns:
        known = incremental.current_offsets(warehouse.offset_log().filter(F.col("tool") == tool))
        normalized = normalize.normalize_codex(raw, broadcast_if_small(known))
    else:
        normalized = normalize.NORMALIZERS[kind](raw)
    if mode == "FAILFAST":
        normalized = normalize.fail_on_reject(normalized)
    store_batch(warehouse, normalized, tool, batch_id, full_refresh)
    digest_batch(warehouse, tool, batch_id)


def digest_batch(warehouse: Warehouse, tool: str, batch_id: int, files: DataFrame | None = None, as_of: Column | None = None) -> None:
    """Digests and logs of a stored batch of one tool; a batch without turns (T9) leaves only its offsets and, with a listing ``files(project, path,
    mtime)``, the file activity as it is now."""
    if files is not None:
        refresh_activity(warehouse, files, batch_id, F.current_timestamp() if as_of is None else as_of)
    if _batch_turns(warehouse, tool, batch_id).isEmpty():
        return
    refresh_digests(warehouse, tool, batch_id)
    extend_logs(warehouse, tool, batch_id)


def store_batch(
    warehouse: Warehouse,
    normalized: DataFrame,
    tool: str,
    batch_id: int,
    full_refresh: bool = False,
) -> None:
    """Records first, offsets after them.

    Positions can only collide with batches that began and did not log their offsets, or with this one on a retry, so the anti join reads just their
    partitions, and there is none if all earlier batches ended well.
    """
    stored = warehouse.records().filter(F.col("tool") == tool)
    unfinished = warehouse.first_unfinished(tool, batch_id)
    warehouse.begin_batch(tool, batch_id)
    if full_refresh:
        normalized = _without_trimmed(incremental.not_yet_stored(normalized, stored), warehouse.trimmed())
    elif unfinished is not None:
        normalized = incremental.not_yet_stored(normalized, stored.filter(F.col("batch_id") >= unfinished))
    warehouse.append_records(normalized, batch_id)
    batch = warehouse.records().filter((F.col("tool") == tool) & (F.col("batch_id") == batch_id))
    warehouse.append_offsets(incremental.advance_offsets(batch), tool, batch_id)
    warehouse.end_batch(tool, batch_id)


def _batch_turns(warehouse: Warehouse, tool: str, batch_id: int) -> DataFrame:
    """Batch ids are counted per tool."""
    return warehouse.records().filter((F.col("status") == "ok") & (F.col("tool") == tool) & (F.col("batch_id") == batch_id))


def refresh_activity(warehouse: Warehouse, files: DataFrame, batch_id: int, as_of: Column) -> None:
    """What is recent now; a project without recent files keeps what it had."""
    warehouse.append_activity(activity.recent_activity(files, as_of), batch_id)


def _newest_projects(turns: DataFrame, offsets: DataFrame) -> DataFrame:
    """The project of each session's newest turn, and that turn's time."""
    found = with_projects(turns, offsets)
    place = F.struct("ts_ms", "source_path", "end_offset")
    return found.groupBy("session_id").agg(F.max_by("project", place).alias("project"), F.max("ts_ms").alias("ts_ms"))


def refresh_digests(warehouse: Warehouse, tool: str, batch_id: int) -> None:
    """Digest again exactly the sessions that got turns in this batch.

    The batch's turns are folded into session state, and digests come from the state: the stored contents of the ledger are
    never read again, only the states of its sessions.
    """
    turns = _batch_turns(warehouse, tool, batch_id)
    warehouse.append_session_state(digest.session_state(turns), tool)
    touched = turns.select("session_id").distinct()
    digests = digest.assemble(warehouse.session_state(touched).join(touched, "session_id", "left_semi"))
    projects = _newest_projects(turns, incremental.current_offsets(warehouse.offset_log())).drop("ts_ms")
    warehouse.append_digests(digest.with_body(digests).join(projects, "session_id", "left"), tool, batch_id)


def rebuild_digests(warehouse: Warehouse, batch_id: int) -> None:
    """Digest every session from the ledger itself."""
    digests = digest.session_digest(warehouse.ledger())
    projects = _newest_projects(warehouse.ledger(), incremental.current_offsets(warehouse.offset_log())).drop("ts_ms")
    warehouse.append_digests(digest.with_body(digests).join(projects, "session_id", "left"), "rebuild", batch_id)


def project_documents(warehouse: Warehouse, git: DataFrame | None = None) -> DataFrame:
    """``(project, body)`` of every project from what the batches have stored. ``git(project, head, diffstat)`` is captured text."""
    latest = project.newest_digests(warehouse.digests())
    context = None if git is None else git.select("project", activity.git_context(F.col("head"), F.col("diffstat")).alias("git_context"))
    lines = project.document_lines(latest, warehouse.history(), warehouse.progress_log(), warehouse.activity(), context)
    return project.render_documents(lines)


def publish(warehouse: Warehouse, folder: str, git: DataFrame | None = None) -> None:
    """A document and a progress file per project below ``folder``, each replaced as a whole."""
    body = project_documents(warehouse, git).select("project", F.lit("digest.md").alias("file"), F.posexplode(F.split(F.regexp_replace("body", "\n$", ""), "\n")).alias("pos", "line"))
    documents.write_files(body, ["pos"], folder)
    latest = project.newest_digests(warehouse.digests())
    log = project.progress_file_lines(latest, warehouse.progress_log()).withColumn("file", F.lit("progress.md"))
    documents.write_files(log, ["part", "pos", "ord", "line"], folder)


def with_projects(turns: DataFrame, offsets: DataFrame, home: Column | None = None) -> DataFrame:
    """P25: the project of each turn, from the turn, its source or its folder."""
    known = offsets.filter("project_dir is not null").select("source_path", F.col("project_dir").alias("source_project"))
    known = broadcast_if_small(known)
    never = F.lit(None).cast("string") if home is None else home
    found = resolve_project(
        F.coalesce("project_dir", "source_project"), F.lit(None).cast("string"), F.col("source_path"), never
    )
    return turns.join(known, "source_path", "left").withColumn("project", F.coalesce(found, F.lit(NO_PROJECT)))


def extend_logs(warehouse: Warehouse, tool: str, batch_id: int) -> None:
    """Append what this batch adds to the progress log and to the history of tasks and next actions."""
    offsets = incremental.current_offsets(warehouse.offset_log())
    turns = with_projects(_batch_turns(warehouse, tool, batch_id), offsets)
    order = F.struct(F.lit(batch_id).cast("bigint").alias("batch_id"), "ts_ms", "source_path", "end_offset")
    entries = distill.progress_entries(turns).select("project", "entry", order.alias("ord"))
    # The projects of all turns, found without looking at a text, are those of the entries and perhaps some more.
    ends = warehouse.progress_ends(turns.select("project").distinct())
    warehouse.append_progress(progress.merge_progress(ends, entries), tool, batch_id)

    times = turns.groupBy("session_id").agg(F.max("ts_ms").alias("ts_ms"))
    digests = warehouse.digest_log().filter((F.col("tool") == tool) & (F.col("batch_id") == batch_id)).join(times, "session_id")
    sections = F.array(
        F.struct(F.lit("task").alias("section"), F.col("task").alias("value")),
        F.struct(F.lit("next_action").alias("section"), F.col("next_action").alias("value")),
    )
    values = digests.select("project", "ts_ms", F.inline(sections))
    warehouse.append_history(progress.history_delta(warehouse.history(progress.history(values)), values), tool)


def ingest_kv(warehouse: Warehouse, documents: DataFrame, batch_id: int) -> None:
    """Key-value stores: prompts of the current layout where a store has composer headers, the older layout elsewhere."""
    if "store" not in documents.columns:
        documents = documents.withColumn("store", F.lit(""))
    documents, oversized = kv.split_oversized(documents)
    documents, staged = _stage_documents(warehouse, documents)
    seen = warehouse.workspace_state()
    prompts = kv.workspace_prompts(documents, seen).select(
        F.lit("cursor").alias("tool"),
        F.concat_ws("/", "store", "workspace_id").alias("source_path"),
        (F.col("pos") + 1).alias("end_offset"),
        F.col("composer_id").alias("session_id"),
        "ts_ms",
        F.lit("user").alias("role"),
        F.col("text").alias("content"),
        F.nullif(F.col("fs_path"), F.lit("")).alias("project_dir"),
        F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("reason"),
    )
    rejected = oversized.withColumn("status", F.lit("rejected"))
    older = _legacy_rows(documents, warehouse.records().filter(F.col("tool") == "cursor"))
    state = kv.workspace_state(documents, seen)
    rows = normalize.finish(prompts.unionByName(rejected, allowMissingColumns=True).unionByName(older, allowMissingColumns=True))
    # Prompt positions shift between reads, so they identify a prompt only within this batch: enough for a retry of it.
    if warehouse.first_unfinished("cursor") is not None:
        same = (F.col("tool") == "cursor") & (F.col("batch_id") == batch_id)
        rows = incremental.not_yet_stored(rows, warehouse.records().filter(same))
    warehouse.begin_batch("cursor", batch_id)
    warehouse.append_records(rows, batch_id)
    warehouse.append_workspace_state(state, batch_id)
    warehouse.end_batch("cursor", batch_id)
    drop_folder(warehouse.spark, staged)
    digest_batch(warehouse, "cursor", batch_id)


def _stage_documents(warehouse: Warehouse, documents: DataFrame) -> tuple[DataFrame, str]:
    """The documents that are read, written once to a folder per key: the steps of a batch look at them up to ten times, each at one key, and what
    made them may be costly. Also the folder, to be removed at the end of the batch."""
    path = f"{shared_dir(warehouse.spark)}/kv-{uuid.uuid4().hex}"
    kept = documents.where(F.col("key").isin(*kv.KEYS)).select(*[c for c in documents.columns if c != "key"], "key")
    kept.write.partitionBy("key").parquet(path)
    return warehouse.spark.read.schema(kept.schema).parquet(path), path


def _legacy_rows(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Turns of stores without composer headers whose record ids are not stored yet for their store and key.

    Ids do not sort in the order they are given (``m:10`` comes before ``m:9``), and a key holds the messages of many composers, so no single id can
    tell what was read; a document is always given whole, and stored ids are looked at for the sources of this batch only. A message without an id of
    its own is known by its content.
    """
    # A row per store; without the broadcast the documents of a store would meet in one task.
    current = broadcast_if_small(documents.filter(F.col("key") == kv.HEADERS_KEY).select("store").distinct())
    turns = kv.legacy_turns(documents.join(current, "store", "left_anti"))
    named = F.when(F.startswith("msg_id", F.lit(":")), F.concat("msg_id", F.lit("#"), F.md5("content"))).otherwise(F.col("msg_id"))
    rows = turns.withColumns({"source_path": F.concat_ws("/", "store", F.lit("legacy"), "source_key"), "msg_id": named})
    # A row per store and key, known without parsing a document.
    sources = broadcast_if_small(documents.select(F.concat_ws("/", "store", F.lit("legacy"), "key").alias("source_path")).distinct())
    known = stored.filter(F.contains("source_path", F.lit("/legacy/"))).join(sources, "source_path", "left_semi")
    fresh = rows.join(known.select("source_path", F.col("record_uuid").alias("msg_id")), ["source_path", "msg_id"], "left_anti")
    return fresh.select(
        "tool", "source_path", F.xxhash64("msg_id").alias("end_offset"), "session_id", "ts_ms", "role", "content",
        F.col("msg_id").alias("record_uuid"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"),
    )


def legacy_kv_turns(documents: DataFrame, watermarks: DataFrame | None = None) -> DataFrame:
    """Turns of the older layout past the stored id of each key."""
    turns = kv.legacy_turns(documents)
    return turns if watermarks is None else incremental.after_last_id(turns, watermarks)


def _without_trimmed(rows: DataFrame, trimmed: DataFrame) -> DataFrame:
    """Rows but for turns that retention has removed; a session that goes on later does so with its new turns."""
    gone = rows.join(trimmed, "session_id", "left").where(F.col("newest_ms").isNull() | F.col("ts_ms").isNull() | (F.col("ts_ms") > F.col("newest_ms")))
    return gone.select(*rows.columns)


def trim(warehouse: Warehouse, before_ms: int) -> None:
    """Remove the sessions whose newest turn is older than a time. A second trim finds none; a later read adds nothing that was removed."""
    newest = warehouse.ledger().groupBy("session_id").agg(F.max("ts_ms").alias("newest_ms"))
    path = f"{shared_dir(warehouse.spark)}/trim-{uuid.uuid4().hex}"
    newest.where(F.col("newest_ms") < before_ms).write.parquet(path)
    old = warehouse.spark.read.schema(newest.schema).parquet(path)
    if not old.isEmpty():
        warehouse.drop_sessions(old)


def open_warehouse(spark: SparkSession, root: str) -> Warehouse:
    return Warehouse(configure(spark), root)
