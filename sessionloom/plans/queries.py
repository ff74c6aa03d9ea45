"""Registered queries: every operator over whole given tables, or over records Spark derives from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import redact as rd
from sessionloom.functions import text as tx
from sessionloom.functions import variant as vr
from sessionloom.operators import activity, digest, distill, hooks, incremental, kv, metrics, normalize, progress, project, reads, redaction, threads, versions, windows
from sessionloom.plans import ingest, views
from sessionloom.session import configure, shared_dir
from sessionloom.sources import jsonl, tail
from sessionloom.streaming import accumulate, live, transcripts
from sessionloom.streaming import signals as notices

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place, one per run."""
    return f"{shared_dir(spark)}/{name}/{uuid.uuid4().hex}"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


# -- distillers -----------------------------------------------------------------------------------------------------------------
@query
def session_task(spark, sf):
    return distill.task(views.plain_ledger(spark, sf))


@query
def session_task_augmented(spark, sf):
    return distill.task(views.augmented_ledger(spark, sf))


@query
def session_next_action(spark, sf):
    return distill.next_action(views.plain_ledger(spark, sf))


@query
def session_next_action_fenced(spark, sf):
    return distill.next_action(views.augmented_ledger(spark, sf))


@query
def session_open_questions(spark, sf):
    return distill.open_questions(views.augmented_ledger(spark, sf))


@query
def project_open_questions(spark, sf):
    return distill.open_questions(views.project_ledger(spark, sf))


@query
def session_failed_approaches(spark, sf):
    return distill.failed_approaches(views.augmented_ledger(spark, sf))


@query
def project_failed_approaches(spark, sf):
    return distill.failed_approaches(views.project_ledger(spark, sf))


@query
def session_recent_files(spark, sf):
    return distill.recent_files(views.augmented_ledger(spark, sf))


@query
def project_recent_files(spark, sf):
    return distill.recent_files(views.project_ledger(spark, sf))


@query
def coding_sessions(spark, sf):
    return distill.coding_sessions(views.augmented_ledger(spark, sf))


@query
def progress_entries(spark, sf):
    return distill.progress_entries(views.plain_ledger(spark, sf)).select("session_id", "ts_ms", "entry")


@query
def progress_entries_augmented(spark, sf):
    return distill.progress_entries(views.augmented_ledger(spark, sf)).select("session_id", "ts_ms", "entry")


def _flat_digest(d: DataFrame) -> DataFrame:
    lists = ("open_questions", "recent_files", "failed_approaches", "progress_entries")
    return d.select(
        "session_id", "source_tool", "timestamp_iso", "task", "next_action",
        *[F.array_join(c, "|").alias(c) for c in lists],
    )


@query
def session_digest(spark, sf):
    return _flat_digest(digest.session_digest(views.augmented_ledger(spark, sf)))


@query
def project_digest(spark, sf):
    return _flat_digest(digest.session_digest(views.project_ledger(spark, sf)))


@query
def digest_render(spark, sf):
    return digest.render_digest(digest.session_digest(views.augmented_ledger(spark, sf)))


@query
def digest_render_long(spark, sf):
    return digest.render_digest(digest.session_digest(views.project_ledger(spark, sf)))


@query
def tool_digest(spark, sf):
    """Long sessions: every entry is in the digest."""
    return _flat_digest(digest.session_digest(views.tool_ledger(spark, sf)))


@query
def tool_digest_render(spark, sf):
    """Long sessions: the rendered document is cut at its last line."""
    return digest.render_digest(digest.session_digest(views.tool_ledger(spark, sf)))


# -- accumulation ---------------------------------------------------------------------------------------------------------------
def _log_and_batch(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The log holds the older half of the turns of two tools; the batch brings everything again, the third tool's turns late."""
    led = views.plain_ledger(spark, sf)
    project = F.concat(F.lit("p"), (F.col("session_id").cast("bigint") % 10).cast("string"))
    led = led.withColumn("project", project)
    border = led.agg(F.floor(F.avg("ts_ms"))).scalar()
    existing = led.filter((F.col("tool") != "cursor") & (F.col("ts_ms") < border))
    as_log = lambda turns: distill.progress_entries(turns).select("project", "entry", F.col("ts_ms").alias("ord"))
    return as_log(existing), as_log(led)


@query
def progress_merge_late(spark, sf):
    existing, batch = _log_and_batch(spark, sf)
    return progress.merge_progress(existing, batch).select("project", "entry")


@query
def progress_merge_lenient(spark, sf):
    """The same merge with five days of allowed lateness."""
    existing, batch = _log_and_batch(spark, sf)
    return progress.merge_progress(existing, batch, allowed_lateness_s=432000).select("project", "entry")


def _history_values(spark, sf) -> DataFrame:
    led = views.plain_ledger(spark, sf)
    project = F.concat(F.lit("p"), (F.col("session_id").cast("bigint") % 10).cast("string"))
    # Every value is logged twice, at the session's first and last turn, so that values repeat within a project.
    times = led.groupBy("session_id").agg(F.array(F.min("ts_ms"), F.max("ts_ms")).alias("times"))
    values = distill.task(led).withColumn("section", F.lit("task")).withColumnRenamed("task", "value")
    values = values.unionByName(
        distill.next_action(led).withColumn("section", F.lit("next_action")).withColumnRenamed("next_action", "value")
    )
    return values.join(times, "session_id").select(
        project.alias("project"), "section", "value", F.explode("times").alias("ts_ms")
    )


@query
def task_history(spark, sf):
    return progress.history(_history_values(spark, sf))


@query
def task_history_newest(spark, sf):
    return progress.newest_history(progress.history(_history_values(spark, sf)), 5)


@query
def task_history_delta(spark, sf):
    """What the whole ledger adds to a history built from its older half."""
    values = _history_values(spark, sf)
    border = views.plain_ledger(spark, sf).agg(F.floor(F.avg("ts_ms"))).scalar()
    return progress.history_delta(progress.history(values.filter(F.col("ts_ms") < border)), values)


@query
def activity_kept(spark, sf):
    """Last non-empty activity per event type; short values count as empty."""
    events = views.table(spark, sf, "events").select(
        "event_type", "event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("file"), F.col("event_id").cast("string"))).otherwise("").alias("activity")
    )
    return progress.last_non_empty(events, "event_type", "activity", F.col("event_id"))


@query
def task_history_stream(spark, sf):
    """Three deliveries, each with all values so far, into keyed state; what the batches added together."""
    folder, values = _scratch(spark, "task_history_stream"), _history_values(spark, sf)
    values.write.parquet(f"{folder}/values")
    values = spark.read.parquet(f"{folder}/values")
    first, last = (values.agg(f("ts_ms")).scalar() for f in (F.min, F.max))
    own = live.stateful_session(spark)
    for third in range(3):
        values.where(3 * (F.col("ts_ms") - first) <= (third + 1) * (last - first)).write.mode("append").parquet(f"{folder}/in")
        found = accumulate.history_stream(own.readStream.schema(values.schema).parquet(f"{folder}/in"))
        accumulate.start_accumulation(found, folder, available_now=True).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch_id")


@query
def activity_kept_stream(spark, sf):
    """The last non-empty value per key after three deliveries in no order of time."""
    folder = _scratch(spark, "activity_kept_stream")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("file"), F.col("event_id").cast("string"))).otherwise("")
    events = views.table(spark, sf, "events").select("event_type", "event_id", name.alias("activity"))
    own = live.stateful_session(spark)
    for delivery in (2, 0, 1):
        events.where(F.col("event_id") % 7 % 3 == delivery).write.mode("append").parquet(f"{folder}/in")
        found = accumulate.last_value_stream(own.readStream.schema(events.schema).parquet(f"{folder}/in"), "event_type", "activity", "event_id")
        accumulate.start_accumulation(found, folder, "update", available_now=True).awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.groupBy(F.col("key").alias("event_type")).agg(F.max_by("value", "ord").alias("activity"))


@query
def tool_metrics(spark, sf):
    """E5: three stored batches merged over tool, week and month; the exact columns (a test holds the estimates against exact counts)."""
    folder, led = _scratch(spark, "tool_metrics"), views.plain_ledger(spark, sf)
    for batch in range(3):
        metrics.batch_metrics(led.where(F.col("ts_ms") / 1000 % 3 == batch)).write.parquet(f"{folder}/batch_id={batch}")
    found = metrics.metrics(spark.read.parquet(folder))
    dates = [F.col(c).cast("string").alias(c) for c in ("week", "month")]
    return found.select("tool", *dates, "level", "n_turns", "n_chars", "first_ms", "last_ms")


def _of_session() -> F.Column:
    return F.concat(F.lit("p"), (F.col("session_id").cast("bigint") % 10).cast("string"))


@query
def project_document(spark, sf):
    """History, activity, version-control context and log of ten projects around their newest digest."""
    led = views.augmented_ledger(spark, sf).withColumn("project", _of_session())
    digests = digest.session_digest(led).withColumn("project", _of_session())
    times = led.groupBy("session_id").agg(F.max("ts_ms").alias("ts_ms"))
    sections = F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).alias("value")) for c in ("task", "next_action")])
    history = progress.history(digests.join(times, "session_id").select("project", "ts_ms", F.inline(sections)))
    entries = distill.progress_entries(led).select("project", "entry", F.col("ts_ms").alias("ord"))
    log = progress.merge_progress(entries.limit(0), entries)
    files = views.event_files(spark, sf).withColumn("project", F.replace("project", F.lit("proj"), F.lit("p")))
    recent = activity.recent_activity(files, files.agg(F.max("mtime")).scalar())
    suppliers = views.table(spark, sf, "supplier").groupBy(F.concat(F.lit("p"), (F.col("s_suppkey") % 10).cast("string")).alias("project"))
    stat = F.when(F.col("k") % 3 > 0, F.concat(F.lit(" a.rs | 2 +-\n "), F.col("k").cast("string"), F.lit(" files changed\n"))).otherwise("")
    head = F.when(F.col("k") % 4 > 0, F.concat(F.lit("c0ffee"), F.col("k").cast("string"))).otherwise("")
    git = suppliers.agg(F.max("s_suppkey").alias("k")).select("project", activity.git_context(head, stat).alias("git_context"))
    lines = project.document_lines(project.newest_digests(digests), history, log, recent, git)
    return project.render_documents(lines)


@query
def retained_digests(spark, sf):
    """All turns ingested, the sessions older than the mean time trimmed twice, everything read again."""
    warehouse = ingest.open_warehouse(spark, _scratch(spark, "retained_digests"))
    led = views.augmented_ledger(spark, sf).withColumns({
        "tool": F.lit("claude"), "source_path": F.lit("conversations"), "end_offset": F.col("ts_ms"), "status": F.lit("ok"), "project_dir": F.lit("/work/p"),
    })
    border = led.agg(F.floor(F.avg("ts_ms")).alias("b")).first().b
    ingest.store_batch(warehouse, normalize.finish(led), "claude", 0)
    ingest.digest_batch(warehouse, "claude", 0)
    ingest.trim(warehouse, border)
    ingest.trim(warehouse, border)
    ingest.store_batch(warehouse, normalize.finish(led), "claude", 1, full_refresh=True)
    ingest.digest_batch(warehouse, "claude", 1)
    return _flat_digest(warehouse.digests())


@query
def project_document_second_batch(spark, sf):
    """The older half of all turns is ingested, then the newer; the documents of the warehouse, written to files and read back."""
    folder = _scratch(spark, "project_document_second_batch")
    warehouse = ingest.open_warehouse(spark, f"{folder}/warehouse")
    led = views.augmented_ledger(spark, sf).withColumns({
        "tool": F.lit("claude"), "source_path": F.lit("conversations"), "end_offset": F.col("ts_ms"), "status": F.lit("ok"),
        "project_dir": F.concat(F.lit("/work/"), _of_session()),
    })
    border = led.agg(F.floor(F.avg("ts_ms"))).scalar()
    for batch, half in enumerate((F.col("ts_ms") < border, F.col("ts_ms") >= border)):
        ingest.store_batch(warehouse, normalize.finish(led.where(half)), "claude", batch)
        ingest.digest_batch(warehouse, "claude", batch)
    ingest.publish(warehouse, f"{folder}/projects")
    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(f"{folder}/projects", wholetext=True)
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(path, "project=([^/]+)/", 1)
    return files.select(F.url_decode(F.url_decode(name)).alias("project"), F.substring_index(path, "/", -1).alias("file"), F.col("value").alias("body"))


# -- ledger reads ---------------------------------------------------------------------------------------------------------------
@query
def query_session(spark, sf):
    return reads.query_session(views.plain_ledger(spark, sf), "7").select("session_id", "ts_ms", "role", "content")


@query
def query_recent(spark, sf):
    return reads.query_recent(views.plain_ledger(spark, sf), "claude", 10).select("session_id", "ts_ms", "role")


@query
def status_top3(spark, sf):
    enabled = spark.createDataFrame([("claude",), ("codex",), ("cursor",), ("other",)], "tool string")
    return reads.status(views.plain_ledger(spark, sf), enabled)


@query
def enabled_turns(spark, sf):
    enabled = spark.createDataFrame([("claude",), ("codex",)], "tool string")
    led = reads.enabled_only(views.plain_ledger(spark, sf), enabled)
    return led.groupBy("tool", "role").agg(F.count(F.lit(1)).alias("n_turns"))


# -- ordered operators ----------------------------------------------------------------------------------------------------------
@query
def idle_sessions(spark, sf):
    rows = windows.assign_idle_sessions(views.table(spark, sf, "events"), "event_type", "ts")
    return rows.select("event_id", "event_type", "session_no")


@query
def idle_session_stats(spark, sf):
    return windows.idle_sessions(views.table(spark, sf, "events"), "event_type", "ts")


@query
def idle_session_stats_by_user(spark, sf):
    return windows.idle_sessions(views.table(spark, sf, "events"), "user_id", "ts", 3600)


@query
def idle_session_live(spark, sf):
    """T4 as a stream over the events in three deliveries, every fiftieth event one delivery late: all sessions, open ones and late events included."""
    folder = _scratch(spark, "idle_session_live")
    events = views.table(spark, sf, "events")
    day = F.pmod(F.datediff("ts", F.lit("1970-01-01")), F.lit(90))
    first, last = (events.agg(f(day)).scalar() for f in (F.min, F.max))
    part = F.least(F.floor(3 * (day - first) / (last - first + 1)), F.lit(2)).cast("int")
    dealt = events.withColumn("delivery", F.when(F.col("event_id") % 50 == 0, F.least(part + 1, F.lit(2))).otherwise(part))
    own = live.stateful_session(spark)
    for delivery in range(3):
        dealt.where(F.col("delivery") == delivery).drop("delivery").write.mode("append").parquet(f"{folder}/in")
        stream = own.readStream.schema(events.schema).parquet(f"{folder}/in")
        live.start_idle_sessions(live.session_updates(stream, "event_type", "ts"), folder, available_now=True).awaitTermination()
    return live.all_sessions(spark.read.parquet(f"{folder}/updates"), "event_type")


@query
def carry_forward_session(spark, sf):
    """A ``signup`` opens a context that every later event of the user belongs to."""
    events = views.table(spark, sf, "events")
    opened = F.when(F.col("event_type") == "signup", F.col("event_id"))
    rows = windows.carry_forward(events, "user_id", "event_id", opened, "context_id", segment_width=4096)
    return rows.filter("context_id is not null").select("event_id", "user_id", "context_id")


@query
def parent_chains(spark, sf):
    """Every turn's parent is the turn before it; some parents are missing and some point ahead."""
    c, t = F.col("conv_id"), F.col("turn")
    name = lambda turn: F.concat(c.cast("string"), F.lit("/"), turn.cast("string"))
    parent = F.when((c % 7 == 3) & (t == 5), "gone").when((c % 11 == 4) & (t == 2), name(F.lit(4))).when(t > 0, name(t - 1))
    rows = views.table(spark, sf, "conversations").select("conv_id", name(t).alias("id"), parent.alias("parent"))
    return threads.parent_chains(rows, "conv_id", "id", "parent")


# -- incremental reads ----------------------------------------------------------------------------------------------------------
def _event_raw(spark, sf) -> DataFrame:
    """``events`` as records of one source per user, the event id being the offset."""
    return views.table(spark, sf, "events").select(
        F.lit("claude").alias("tool"), F.col("user_id").cast("string").alias("source_path"),
        F.col("event_id").alias("end_offset"), "event_type", "ts",
    )


def _event_offsets(spark, sf) -> DataFrame:
    """Stored state: two thirds of the sources, read up to their median event."""
    raw = _event_raw(spark, sf).filter(F.col("source_path").cast("bigint") % 3 != 0)
    return raw.groupBy("tool", "source_path").agg(
        F.floor((F.min("end_offset") + F.max("end_offset")) / 2).alias("byte_offset"),
        F.lit(5).cast("bigint").alias("last_event_seq"),
        F.lit(None).cast("string").alias("last_uuid"),
        F.lit(None).cast("string").alias("last_session_id"),
        F.concat(F.lit("/work/"), F.first("source_path")).alias("project_dir"),
    )


@query
def incremental_read(spark, sf):
    raw = incremental.read_since(_event_raw(spark, sf), _event_offsets(spark, sf))
    return raw.select("source_path", "end_offset", "event_type")


@query
def offset_advance(spark, sf):
    """Sequence number: the running maximum over purchases only; uuid: the last click."""
    kind = F.col("event_type")
    records = _event_raw(spark, sf).select(
        "tool", "source_path", "end_offset",
        F.when(kind == "purchase", F.col("end_offset") % 1000).alias("event_seq"),
        F.when(kind == "click", F.concat(F.lit("u"), F.col("end_offset").cast("string"))).alias("record_uuid"),
        F.when(kind == "signup", F.concat(F.lit("s"), F.col("end_offset").cast("string"))).alias("context_session_id"),
        F.lit(None).cast("string").alias("project_dir"),
    )
    return incremental.advance_offsets(records).select(
        "source_path", "byte_offset", "last_event_seq", "last_uuid", "last_session_id"
    )


@query
def offset_merge(spark, sf):
    """New state of every source, with a lower offset for some; neither the offset nor the project may be lost."""
    new = _event_raw(spark, sf).groupBy("tool", "source_path").agg(
        F.when(F.col("source_path").cast("bigint") % 2 == 0, F.max("end_offset")).otherwise(F.lit(1)).alias("byte_offset"),
        F.lit(9).cast("bigint").alias("last_event_seq"),
        F.concat(F.lit("u"), F.col("source_path")).alias("last_uuid"),
    )
    return incremental.merge_offsets(_event_offsets(spark, sf), new).select(
        "source_path", "byte_offset", "last_event_seq", "last_uuid", "project_dir"
    )


@query
def rescan_dedupe(spark, sf):
    raw = _event_raw(spark, sf)
    stored = raw.filter(F.col("end_offset") % 4 != 0)
    return incremental.not_yet_stored(raw, stored).select("source_path", "end_offset")


@query
def known_projects(spark, sf):
    return incremental.known_projects(_event_offsets(spark, sf))


@query
def scan_offsets(spark, sf):
    """Writes the conversations as text, eight files, and reads them back with byte offsets."""
    conv = views.table(spark, sf, "conversations")
    line = F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", F.replace("text", F.lit("\n"), F.lit(" ")))
    folder = _scratch(spark, "scan_offsets")
    (
        conv.select((F.col("conv_id") % 8).alias("source"), "conv_id", "turn", line.alias("value"))
        .repartition("source")
        .sortWithinPartitions("source", "conv_id", "turn")
        .select("source", "value")
        .write.option("lineSep", "\n")
        .partitionBy("source")
        .text(folder)
    )
    raw = jsonl.scan_path(spark, "claude", folder, glob="*.txt")
    parts = F.split("line", "\\|")
    return raw.select(
        F.regexp_extract("source_path", "source=(\\d+)", 1).cast("bigint").alias("source"),
        F.get(parts, 0).cast("bigint").alias("conv_id"),
        F.get(parts, 1).cast("bigint").alias("turn"),
        "start_offset",
        "end_offset",
    )


def _tail_rows(found: DataFrame) -> DataFrame:
    parts = F.split("line", "\\|")
    return found.select(
        F.regexp_extract("source_path", "source=(\\d+)", 1).cast("bigint").alias("source"), F.get(parts, 0).cast("bigint").alias("conv_id"),
        F.get(parts, 1).cast("bigint").alias("turn"), "start_offset", "end_offset", "piece",
    )


@query
def tail_batch(spark, sf):
    """Files that grow by a second piece; the second read starts at the offsets of the first."""
    folder, lines = _scratch(spark, "tail_batch"), views.growing_lines(spark, sf)
    at, known = tail.qualified(spark, f"{folder}/in"), None
    for piece in (1, 2):
        views.write_piece(lines, at, piece)
        tail.read_new(spark, "claude", at, known, "*.txt").write.parquet(f"{folder}/out/piece={piece}")
        stored = spark.read.parquet(f"{folder}/out")
        known = stored.groupBy("source_path").agg(F.max("end_offset").alias("byte_offset"))
    return _tail_rows(stored)


@query
def tail_stream(spark, sf):
    """The same growth seen by a stream, one trigger after each piece; its checkpoint holds the offsets."""
    folder, lines = _scratch(spark, "tail_stream"), views.growing_lines(spark, sf)
    at = tail.qualified(spark, f"{folder}/in")

    def keep(batch: DataFrame, batch_id: int) -> None:
        tail.as_raw(batch, "claude").write.mode("overwrite").parquet(f"{folder}/out/piece={batch_id + 1}")

    for piece in (1, 2):
        views.write_piece(lines, at, piece)
        writer = tail.tail_stream(spark, at, "*.txt").writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    return _tail_rows(spark.read.parquet(f"{folder}/out"))


@query
def partial_tail(spark, sf):
    """Every file ends inside a line, which neither reader gives out: the scan by Spark and the read from a byte on."""
    at = tail.qualified(spark, _scratch(spark, "partial_tail"))
    views.write_piece(views.growing_lines(spark, sf), at, 1)
    readers = {"scan": jsonl.scan_path(spark, "claude", at, glob="*.txt"), "tail": tail.read_new(spark, "claude", at, None, "*.txt")}
    scan, rest = (_tail_rows(raw.withColumn("piece", F.lit(1))).drop("piece").withColumn("reader", F.lit(name)) for name, raw in readers.items())
    return scan.unionByName(rest)


@query
def limited_reads(spark, sf):
    """A stream held to one byte a trigger, which takes a file each time: what every file gave and how many files the largest trigger took."""
    folder, lines = _scratch(spark, "limited_reads"), views.growing_lines(spark, sf)
    by_source = lines.select((F.col("source") % 4).alias("source"), "line").repartition("source").sortWithinPartitions("source")
    by_source.write.option("lineSep", "\n").partitionBy("source").text(f"{folder}/in")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/trigger={batch_id}")

    writer = transcripts.transcript_stream(spark, f"{folder}/in", "*.txt", max_bytes=1).writeStream.foreachBatch(keep)
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    source = F.regexp_extract("source_path", "source=(\\d+)", 1).cast("bigint").alias("source")
    found = spark.read.parquet(f"{folder}/out").select(source, "trigger", F.octet_length("line").alias("n"))
    widest = found.groupBy("trigger").agg(F.count_distinct("source").alias("files")).agg(F.max("files").alias("widest_trigger"))
    per_file = found.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("n") + 1).cast("bigint").alias("n_bytes"), F.count_distinct("trigger").alias("n_triggers")
    )
    return per_file.join(F.broadcast(widest))  # one row


@query
def dated_tree(spark, sf):
    """A tree of sessions by year, month and day: the listing, and how far each file was read."""
    folder = _scratch(spark, "dated_tree")
    line = F.concat_ws("|", F.col("session_id"), "role", F.replace("content", F.lit("\n"), F.lit(" ")))
    day = F.timestamp_millis("ts_ms")
    dated = views.plain_ledger(spark, sf).select(
        F.date_format(day, "yyyy").alias("y"), F.date_format(day, "MM").alias("m"), F.date_format(day, "dd").alias("d"), "ts_ms", line.alias("value")
    )
    ordered = dated.repartition("y", "m", "d").sortWithinPartitions("y", "m", "d", "ts_ms").drop("ts_ms")
    ordered.write.option("lineSep", "\n").partitionBy("y", "m", "d").text(folder)
    at = tail.qualified(spark, folder)
    name = F.regexp_extract("source_path", "y=(\\d+)/m=(\\d+)/d=(\\d+)/", 0).alias("day")
    listed = jsonl.list_sources(spark, at, "*.txt").select(name, "size")
    read = tail.read_new(spark, "codex", at, None, "*.txt").groupBy(name).agg(F.count(F.lit(1)).alias("n_records"), F.max("end_offset").alias("read_to"))
    return listed.join(read, "day", "left")


@query
def history_ingest(spark, sf):
    """Rollouts and the prompt history of one tool as two sources of one warehouse, each with offsets of its own."""
    folder = _scratch(spark, "history_ingest")
    for name, raw in (("rollouts", views.event_records(spark, sf)), ("history", views.history_records(spark, sf))):
        ordered = raw.repartition("source_path").sortWithinPartitions("source_path", "start_offset")
        ordered.select(F.col("source_path").alias("file"), "line").write.option("lineSep", "\n").partitionBy("file").text(f"{folder}/{name}")
    warehouse = ingest.open_warehouse(spark, f"{folder}/warehouse")
    ingest.ingest_path(warehouse, "codex", f"{folder}/rollouts", 0, glob="*.txt")
    ingest.ingest_path(warehouse, "codex", f"{folder}/history", 1, glob="*.txt", source_kind="codex_history")
    return warehouse.ledger().select(
        F.regexp_extract("source_path", "/(rollouts|history)/file=", 1).alias("source_kind"), "session_id", "ts_ms", "role", "content"
    )


@query
def signals_ingest(spark, sf):
    """Hook envelopes and watch events as two landed streams drive the ingest.

    The first delivery names one tool; the second, after its transcripts grew, asks for a rescan, which reads every tool from the start and stores
    nothing twice. ``batch_id`` tells which delivery brought a turn.
    """
    folder = _scratch(spark, "signals_ingest")
    warehouse = ingest.open_warehouse(spark, f"{folder}/warehouse")
    ours = views.json_records(spark, sf).withColumn("late", (F.col("start_offset") % 2 == 1).cast("int"))
    views.flat_records(spark, sf).select("line").write.option("lineSep", "\n").text(f"{folder}/cursor")
    posted = _envelopes(spark, sf).drop("event_id").withColumns({"extra": F.create_map().cast("map<string,string>"), "ts": F.lit("2024-01-01T00:00:00Z")})
    e = views.table(spark, sf, "events")
    seen = e.select(
        F.lit("cursor").alias("tool"), F.when(F.col("event_id") % 50 == 0, "").otherwise(F.col("event_type")).alias("path"),
        F.when(F.col("event_type") == "view", "access").otherwise("modify").alias("kind"), F.lit("2024-01-01T00:00:00Z").alias("ts"),
        (F.col("event_id") % 50 == 0).alias("rescan"),
    )
    deliveries = (
        (posted.where("tool in ('claude', 'vim')"), seen.where("kind = 'access' and not rescan")),
        (posted, seen),
    )
    for late, (hook, watch) in enumerate(deliveries):
        ours.where(F.col("late") == late).select("line").write.mode("append").option("lineSep", "\n").text(f"{folder}/claude")
        hook.write.mode("append").json(f"{folder}/hooks")
        watch.write.mode("append").json(f"{folder}/watched")
        stream = notices.signals(
            notices.hook_stream(spark, f"{folder}/hooks"),
            spark.readStream.schema("tool string, path string, kind string, ts timestamp, rescan boolean").json(f"{folder}/watched"),
        )
        roots = {tool: f"{folder}/{tool}" for tool in ("claude", "cursor")}
        transcripts.ingest_on_signals(warehouse, stream, roots, f"{folder}/state", glob="*.txt", available_now=True).awaitTermination()
    return warehouse.records().where("status = 'ok'").select("tool", "batch_id", "session_id", "ts_ms", "role", "content")


@query
def replayed_batch(spark, sf):
    """A batch that died between its records and its offsets, replayed under its id, and replayed once more when it had ended."""
    warehouse = ingest.open_warehouse(spark, _scratch(spark, "replayed_batch"))
    raw = views.json_records(spark, sf)
    warehouse.begin_batch("claude", 0)
    warehouse.append_records(normalize.normalize_claude(raw.where("end_offset % 3 = 0")), 0)
    for _ in range(2):
        ingest.store_batch(warehouse, normalize.normalize_claude(raw), "claude", 0)
    turns = warehouse.ledger().groupBy("session_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("content")).alias("n_chars"))
    read = incremental.current_offsets(warehouse.offset_log()).agg(F.sum("byte_offset").alias("read_to"))
    return turns.join(F.broadcast(read))  # one row


@query
def refreshed_activity(spark, sf):
    """Batches without turns refresh the file activity; a project that has none now keeps its last."""
    warehouse = ingest.open_warehouse(spark, _scratch(spark, "refreshed_activity"))
    files = views.event_files(spark, sf)
    last = files.agg(F.max("mtime")).scalar()
    earlier = last - F.expr("interval 3 hours")
    ingest.digest_batch(warehouse, "claude", 0, files.where(F.col("mtime") <= earlier), earlier)
    ingest.digest_batch(warehouse, "claude", 1, files.where("project not in ('proj0', 'proj3')"), last)
    return warehouse.activity()


@query
def ingest_digests(spark, sf):
    """End to end: records written as JSON lines, ingested into a new warehouse, the stored digests read back."""
    folder = _scratch(spark, "ingest_digests")
    views.json_records(spark, sf).select("line").write.option("lineSep", "\n").text(f"{folder}/claude")
    warehouse = ingest.open_warehouse(spark, f"{folder}/warehouse")
    ingest.ingest_path(warehouse, "claude", f"{folder}/claude", 0, glob="*.txt")
    return _flat_digest(warehouse.digests())


# -- normalisation --------------------------------------------------------------------------------------------------------------
_TURN = ("session_id", "ts_ms", "role", "content", "tool_calls_json", "files_touched_json", "parent_id")


@query
def jsonl_normalize_claude(spark, sf):
    return normalize.turns(normalize.normalize_claude(views.json_records(spark, sf))).select(*_TURN)


@query
def jsonl_normalize_codex(spark, sf):
    return normalize.turns(normalize.normalize_codex(views.event_records(spark, sf))).select(
        *[c for c in _TURN if c != "parent_id"]
    )


@query
def jsonl_normalize_cursor(spark, sf):
    return normalize.turns(normalize.normalize_cursor(views.flat_records(spark, sf))).select("session_id", "ts_ms", "role", "content")


@query
def prompt_history(spark, sf):
    return normalize.turns(normalize.normalize_codex_history(views.history_records(spark, sf))).select(
        "session_id", "ts_ms", "role", "content"
    )


@query
def rejects_by_reason(spark, sf):
    found = normalize.rejects(normalize.normalize_claude(views.json_records(spark, sf)))
    found = found.unionByName(normalize.rejects(normalize.normalize_cursor(views.flat_records(spark, sf))))
    return found.groupBy("tool", "reason").agg(F.count(F.lit(1)).alias("n_records"))


@query
def ledger_union(spark, sf):
    """Three tools and the prompt history in one ledger; history rows repeat their rollout turns."""
    led = normalize.turns(normalize.normalize_claude(views.json_records(spark, sf)))
    for frame in (
        normalize.normalize_codex(views.event_records(spark, sf)),
        normalize.normalize_codex_history(views.history_records(spark, sf)),
        normalize.normalize_cursor(views.flat_records(spark, sf)),
    ):
        led = led.unionByName(normalize.turns(frame))
    return led.groupBy("tool", "role").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("content")).alias("n_chars"), F.min("ts_ms").alias("first_ms")
    )


@query
def history_dedupe(spark, sf):
    """Optional duplicate removal between prompt history and rollout."""
    led = normalize.turns(normalize.normalize_codex(views.event_records(spark, sf))).unionByName(
        normalize.turns(normalize.normalize_codex_history(views.history_records(spark, sf)))
    )
    kept = normalize.drop_history_duplicates(led)
    return kept.groupBy("role").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("content")).alias("n_chars"))


@query
def source_projects(spark, sf):
    """J4 with the first record of every conversation taken as the first line of a file."""
    raw = views.event_records(spark, sf)
    conv = F.floor(F.col("start_offset") / 1000)
    raw = raw.withColumn("source_path", F.concat_ws("/", "source_path", conv.cast("string"))).withColumn(
        "start_offset", F.col("start_offset") % 1000
    )
    return normalize.file_projects(raw)


@query
def props_extract(spark, sf):
    events = views.table(spark, sf, "events")
    parsed = events.withColumn("v", vr.parse(F.col("props"))).withColumn("k", vr.get(F.col("v"), ".k"))
    return parsed.select("event_id", F.when(vr.well_formed(F.col("v")), vr.as_long(F.col("k"))).alias("k"))


# -- key-value stores -----------------------------------------------------------------------------------------------------------
@query
def composer_headers(spark, sf):
    return kv.composers(views.kv_documents(spark, sf)).select("composer_id", "workspace_id", "fs_path", "last_updated_ms")


@query
def newest_composers(spark, sf):
    found = kv.newest_composers(kv.composers(views.kv_documents(spark, sf)), 20)
    return found.select("composer_id", "fs_path", "last_updated_ms")


@query
def composer_prompts(spark, sf):
    return kv.workspace_prompts(views.kv_documents(spark, sf)).drop("fs_path")


@query
def positional_ts(spark, sf):
    """J3 alone: the time of every prompt."""
    return kv.workspace_prompts(views.kv_documents(spark, sf)).select("workspace_id", "pos", "ts_ms")


@query
def composer_prompts_resumed(spark, sf):
    """Second read: every even workspace knows its first prompt's text, every fifth only a count."""
    docs = views.kv_documents(spark, sf)
    asked = views.table(spark, sf, "conversations").filter("role = 'user'").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("first_text")
    )
    seen = asked.filter("conv_id % 2 = 0 or conv_id % 5 = 0").select(
        F.concat(F.lit("ws"), F.col("conv_id").cast("string")).alias("workspace_id"),
        F.lit(1).alias("n_seen"),
        F.when(F.col("conv_id") % 4 == 0, F.col("first_text")).when(F.col("conv_id") % 2 == 0, "gone").alias("last_text"),
    )
    return kv.workspace_prompts(docs, seen).drop("fs_path")


@query
def workspace_state(spark, sf):
    return kv.workspace_state(views.kv_documents(spark, sf))


@query
def legacy_messages(spark, sf):
    turns = kv.legacy_turns(views.legacy_documents(spark, sf))
    return turns.select("session_id", "ts_ms", "role", "content", "msg_id", "source_key")


@query
def legacy_watermark(spark, sf):
    """What is left after a first read that stopped at a middle id of each key."""
    turns = kv.legacy_turns(views.legacy_documents(spark, sf)).select("msg_id", "source_key")
    first = turns.filter(~F.contains("msg_id", F.lit("9")))
    return incremental.after_last_id(turns, incremental.last_ids(first))


@query
def ingest_kv_growing(spark, sf):
    """Documents of the older layout read twice, conversations having six turns at most the first time."""
    warehouse = ingest.open_warehouse(spark, _scratch(spark, "ingest_kv_growing"))
    for batch, turns in enumerate((6, None)):
        ingest.ingest_kv(warehouse, views.legacy_documents(spark, sf, turns), batch)
    key = F.substring_index("source_path", "/", -1).alias("source_key")
    return warehouse.ledger().select("session_id", "ts_ms", "role", "content", F.col("record_uuid").alias("msg_id"), key)


@query
def safe_ids(spark, sf):
    ids = views.table(spark, sf, "events").select(
        "event_id",
        F.concat(
            F.when(F.col("event_id") % 5 == 0, F.repeat(F.col("event_type"), F.lit(14))).otherwise(F.col("event_type")),
            F.when(F.col("event_id") % 3 == 0, "-").when(F.col("event_id") % 3 == 1, "/").otherwise("_"),
            F.when(F.col("event_id") % 7 == 0, "x\n").otherwise("x"),
        ).alias("id"),
    )
    return ids.filter(kv.is_safe_id(F.col("id"))).select("event_id", "id")


@query
def oversized_values(spark, sf):
    docs = views.table(spark, sf, "documents").select(
        F.col("source").alias("workspace_id"), F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value")
    )
    _, rejected = kv.split_oversized(docs, cap=4096)
    return rejected.select("source_path", "reason")


# -- notifications and files ----------------------------------------------------------------------------------------------------
def _envelopes(spark, sf) -> DataFrame:
    e = views.table(spark, sf, "events")
    i = F.col("event_id")
    return e.select(
        i.alias("event_id"),
        F.when(i % 9 == 0, "vim").when(i % 3 == 0, "claude").when(i % 3 == 1, "codex").otherwise("cursor").alias("tool"),
        F.col("event_type").alias("event"),
        F.concat(F.when(i % 10 == 0, "/t/../").otherwise("/t/..a/"), i.cast("string"), F.lit(".jsonl")).alias("transcript_path"),
        F.col("user_id").cast("string").alias("session_id"),
        F.when(i % 4 == 0, "work/rel").when(i % 8 == 1, "/work/..").when(i % 8 == 2, None).otherwise(
            F.concat(F.lit("/work/"), F.col("user_id").cast("string"))
        ).alias("cwd"),
    )


@query
def hook_validate(spark, sf):
    return hooks.validate(_envelopes(spark, sf)).select("event_id", "tool", "cwd", "reject_reason")


@query
def project_routing(spark, sf):
    good = hooks.validate(_envelopes(spark, sf)).filter("reject_reason is null")
    explicit = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("/known/"), F.col("session_id")))
    source = F.concat(F.lit("/t/"), hooks.slug(F.concat(F.lit("/home/u/p"), F.col("session_id"))), F.lit("/a.jsonl"))
    return good.select("event_id", hooks.resolve_project(explicit, F.col("cwd"), source, F.lit("/work/7")).alias("project"))


@query
def watch_events(spark, sf):
    e = views.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "view", "access").when(F.col("event_type") == "click", "modify").otherwise("create").alias("kind"),
        (F.col("event_id") % 50 == 0).alias("rescan"),
    )
    return hooks.keep_watch_kinds(e).select("event_id", "kind")


@query
def burst_coalesce(spark, sf):
    """Time runs ten thousand times faster than in the table, so bursts exist."""
    start = 1704067200000000
    us = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - start) / 10000) + start
    e = views.table(spark, sf, "events").select(
        F.lit("claude").alias("tool"), F.col("event_type").alias("path"), F.timestamp_micros(us).alias("ts"),
        (F.col("event_id") % 50 == 0).alias("rescan"),
    )
    return hooks.coalesce_bursts(e)


@query
def recent_activity(spark, sf):
    files = views.event_files(spark, sf)
    as_of = files.agg(F.max("mtime")).scalar()
    return activity.recent_activity(files, as_of)


@query
def latest_source_per_project(spark, sf):
    return reads.newest_per_project(views.event_files(spark, sf))


@query
def active_source(spark, sf):
    files = views.event_files(spark, sf).filter(F.endswith("path", F.lit(".jsonl"))).select(
        "path", "mtime", F.when(F.col("project") != "proj3", F.col("project")).alias("cwd")
    )
    projects = views.event_files(spark, sf).select("project").distinct()
    return reads.active_source(projects, files)


@query
def git_context_lines(spark, sf):
    docs = views.table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.sha1(F.col("doc_id").cast("string").cast("binary"))).alias("head"),
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit(" a.rs | 3 +-\n"), F.col("text"))).alias("stat"),
    )
    return docs.select("doc_id", activity.git_context(F.col("head"), F.col("stat")).alias("git_context"))


@query
def diffstat_summary(spark, sf):
    """Every document as a captured diff statistic, its words being the files; every eleventh line is a summary."""
    line = lambda word, i: F.when(i % 11 == 10, F.lit("  2 files changed, 3 insertions(+)")).otherwise(
        F.concat(
            F.lit(" src/w"), i.cast("string"), F.lit(".rs  | "), F.length(word).cast("string"), F.lit(" "),
            F.repeat(F.lit("+"), F.length(word)), F.lit("--"),
        )
    )
    body = F.array_join(F.transform(F.split("text", " "), line), "\n")
    docs = views.table(spark, sf, "documents").select("doc_id", body.alias("body"))
    return activity.diffstat_lines(docs, "doc_id", "body")


# -- text -----------------------------------------------------------------------------------------------------------------------
@query
def text_functions(spark, sf):
    """F1-F4, F13, F14 over the documents."""
    t = F.col("text")
    docs = views.table(spark, sf, "documents").withColumn("low", F.lower("text"))
    return docs.select(
        "doc_id",
        tx.truncate_at_word(t, 200).alias("cut"),
        tx.first_line(t).alias("first"),
        F.md5(tx.collapse(t).cast("binary")).alias("collapsed_md5"),
        tx.contains_any(F.col("low"), tx.RETRY_PHRASES).alias("retry"),
        tx.hard_truncate(t, 60, tx.ELLIPSIS).alias("hard"),
    )


@query
def section_extract(spark, sf):
    """The task section of rendered digests, and its bullet."""
    body = digest.render_digest(digest.session_digest(views.augmented_ledger(spark, sf)))
    task = F.col("task")
    body = body.withColumn("task", tx.section(F.col("body"), "Task"))
    return body.select("session_id", tx.bullet_ts(task).alias("at"), tx.bullet_value(task).alias("value"))


def _documents_with_paths(spark, sf) -> DataFrame:
    """Documents with secret-shaped and path-shaped text put in by rule; the prefixes are assembled here."""
    i = F.col("doc_id")
    s = i.cast("string")
    extra = F.concat(
        F.when(i % 3 == 0, F.concat(F.lit(" /home/u"), (i % 4).cast("string"), F.lit("/proj/a.rs and /home/u0/proj/a.rs, then /Users/bob/x"), s)).otherwise(""),
        F.when(i % 4 == 1, F.concat(F.lit(" C:\\Users\\eve\\f"), s, F.lit(".txt; /Users/bob/x"), s, F.lit(" ."))).otherwise(""),
        F.when(i % 5 == 0, F.concat(F.lit(" sk-"), F.repeat(F.lit("a1B2"), F.lit(6)))).otherwise(""),
        F.when(i % 7 == 0, F.concat(F.lit(" PassWord :  "), s, F.lit("!x y"))).otherwise(""),
        F.when(i % 8 == 0, F.concat(F.lit(" token="), F.repeat(F.lit("t0k."), F.lit(4)))).otherwise(""),
        F.when(i % 9 == 0, F.concat(F.lit(" Authorization: Bearer "), F.repeat(F.lit("Zz9"), F.lit(5)), F.lit("=="))).otherwise(""),
        F.when(i % 10 == 0, F.concat(F.lit(" ghp_"), F.repeat(F.lit("abcd"), F.lit(10)))).otherwise(""),
        F.when(i % 11 == 0, F.concat(F.lit(" eyJ"), s, F.lit(".b_-"), s, F.lit(".c"))).otherwise(""),
        F.when(i % 13 == 0, F.concat(F.lit(" mail a.b+c@ex"), s, F.lit(".example.org_d@e.io"))).otherwise(""),
    )
    return views.table(spark, sf, "documents").select("doc_id", F.concat(F.col("text"), extra).alias("text"))


@query
def redact_documents(spark, sf):
    return rd.redact(views.table(spark, sf, "documents").select("doc_id", "text"), "text")


@query
def redact_augmented(spark, sf):
    return rd.redact(_documents_with_paths(spark, sf), "text")


@query
def redact_run(spark, sf):
    """Path numbers over all documents in order of their id."""
    return redaction.redact_run(_documents_with_paths(spark, sf), "doc_id", "text")


@query
def redact_selfcheck(spark, sf):
    docs = _documents_with_paths(spark, sf).withColumn("leaks_before", rd.leaks(F.col("text")))
    clean = rd.redact(docs, "text").select("leaks_before", rd.leaks(F.col("text")).alias("leaks_after"))
    return clean.groupBy("leaks_before", "leaks_after").agg(F.count(F.lit(1)).alias("n_docs"))


# -- versions -------------------------------------------------------------------------------------------------------------------
VERSION_RANGES = (
    ("claude", "1.0.0", "1.4.0", "first"),
    ("claude", "1.4.0", "3.0.0", "second"),
    ("cursor", "0.4.0", None, "open"),
    ("codex", "0.1.0", "2.0.0", "only"),
)


@query
def version_lookup(spark, sf):
    p = F.col("p_partkey")
    printed = F.concat(
        F.lit("tool v"), (F.col("p_size") % 5).cast("string"), F.lit("."), (p % 12).cast("string"), F.lit("."), (p % 7).cast("string"), F.lit(" (stable)")
    )
    parts = views.table(spark, sf, "part").select(
        "p_partkey",
        F.when(p % 4 == 0, "claude").when(p % 4 == 1, "cursor").when(p % 4 == 2, "codex").otherwise("vim").alias("tool"),
        versions.extract_version(printed).alias("version"),
    )
    rows = spark.createDataFrame(list(VERSION_RANGES), "tool string, lo string, hi string, name string")
    ranges = rows.select(
        "tool", versions.extract_version(F.col("lo")).alias("min"), versions.extract_version(F.col("hi")).alias("max"), "name"
    )
    return versions.lookup(parts, ranges).select("p_partkey", "tool", "name", "fallback")
