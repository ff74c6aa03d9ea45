"""Tables of the warehouse folder.

Everything is append-only Parquet. A batch is written once, with skipped and rejected records beside the turns in their own
partition, and the later steps read the written batch instead of parsing the input again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import digest, incremental, progress
from sessionloom.operators.normalize import NORMALIZED
from sessionloom.schemas import LEDGER, OFFSETS
from sessionloom.sources.keyed import KeyedTable


@dataclass(frozen=True)
class Warehouse:
    spark: SparkSession
    root: str

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _read(self, name: str, schema: str) -> DataFrame:
        """The table, or no rows if nothing was written to it yet."""
        try:
            return self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    # -- batches -----------------------------------------------------------------------------------------------------------
    def _mark(self, tool: str, batch_id: int, step: str) -> None:
        row = self.spark.createDataFrame([(tool, batch_id, step)], self._BATCHES)
        row.coalesce(1).write.mode("append").parquet(self._path("batches"))

    _BATCHES = "tool string, batch_id bigint, step string"

    def begin_batch(self, tool: str, batch_id: int) -> None:
        self._mark(tool, batch_id, "begun")

    def end_batch(self, tool: str, batch_id: int) -> None:
        self._mark(tool, batch_id, "done")

    def first_unfinished(self, tool: str, batch_id: int | None = None) -> int | None:
        """Lowest id of the batches that began but whose offsets were never logged, or of ``batch_id`` if it began before, ended or not: a stream may
        repeat a batch whose end it did not get to note. One value."""
        steps = self._read("batches", self._BATCHES).filter(F.col("tool") == tool)
        ended = steps.filter((F.col("step") == "done") & ~F.col("batch_id").eqNullSafe(F.lit(batch_id))).select("batch_id")
        return steps.join(ended, "batch_id", "left_anti").agg(F.min("batch_id")).first()[0]

    # -- records -----------------------------------------------------------------------------------------------------------
    def records(self) -> DataFrame:
        """Every stored record: turns, skipped and rejected ones."""
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NORMALIZED.fields)
        return self._read("records", f"{ddl}, batch_id bigint")

    def append_records(self, normalized: DataFrame, batch_id: int) -> None:
        """One write for turns, skipped and rejected records.

        Partitions by status, tool and batch let every later step of a batch prune to that batch; inside a file turns are
        sorted by session and time, whose column statistics serve the read queries.
        """
        partitions = ["status", "tool", "batch_id"]
        (
            normalized.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .sortWithinPartitions(*partitions, "session_id", "ts_ms")
            .write.mode("append")
            .partitionBy(*partitions)
            .parquet(self._path("records"))
        )

    def ledger(self) -> DataFrame:
        return self.records().filter("status = 'ok'").select(*LEDGER.fieldNames())

    def rejects(self) -> DataFrame:
        """S11."""
        rejected = self.records().filter("status = 'rejected'")
        return rejected.select("tool", "source_path", "end_offset", "reason", "batch_id")

    # -- offsets -----------------------------------------------------------------------------------------------------------
    def _offsets(self) -> KeyedTable:
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OFFSETS.fields)
        fold = lambda log: incremental.current_offsets(log).withColumn("batch_id", F.lit(-1).cast("bigint"))
        return KeyedTable(self.spark, self._path("offsets"), f"{ddl}, batch_id bigint", ("source_path",), fold, buckets=16)

    def offset_log(self) -> DataFrame:
        """What batches logged, older entries folded to one per source."""
        return self._offsets().read()

    def append_offsets(self, advanced: DataFrame, tool: str, batch_id: int) -> None:
        """S10. Logged after the records of a batch, so a logged batch is a complete one."""
        rows = advanced.select(*OFFSETS.fieldNames(), F.lit(batch_id).cast("bigint").alias("batch_id"))
        self._offsets().append(rows, tool)

    # -- key-value state ---------------------------------------------------------------------------------------------------
    def workspace_state(self) -> DataFrame:
        """Latest prompt state per workspace."""
        log = self._read(
            "workspace_state", "store string, workspace_id string, n_seen int, last_text string, batch_id bigint"
        )
        latest = F.max_by(F.struct("n_seen", "last_text"), F.col("batch_id"))
        return log.groupBy("store", "workspace_id").agg(latest.alias("s")).select("store", "workspace_id", "s.*")

    def append_workspace_state(self, state: DataFrame, batch_id: int) -> None:
        rows = state.select("store", "workspace_id", "n_seen", "last_text", F.lit(batch_id).cast("bigint").alias("batch_id"))
        rows.write.mode("append").parquet(self._path("workspace_state"))

    # -- session state -----------------------------------------------------------------------------------------------------
    _STATE = (
        "session_id string, kind string, key string, value string, "
        "pos struct<ord:struct<ts_ms:bigint,source_path:string,end_offset:bigint>,line:int,item:int>"
    )

    def _session_state(self) -> KeyedTable:
        return KeyedTable(self.spark, self._path("session_state"), self._STATE, ("session_id",), digest.merged_state)

    def session_state(self, touched: DataFrame | None = None) -> DataFrame:
        """States of all sessions, or those that share a bucket with ``touched(session_id)``."""
        return self._session_state().read(touched)

    def append_session_state(self, rows: DataFrame, tool: str) -> None:
        self._session_state().append(rows, tool)

    # -- digests -----------------------------------------------------------------------------------------------------------
    _DIGEST = (
        "session_id string, source_tool string, timestamp_iso string, task string, next_action string, "
        "open_questions array<string>, recent_files array<string>, failed_approaches array<string>, "
        "progress_entries array<string>, body string, project string, tool string, batch_id bigint"
    )

    def digest_log(self) -> DataFrame:
        return self._read("session_digest", self._DIGEST)

    def append_digests(self, digests: DataFrame, tool: str, batch_id: int) -> None:
        """Refreshed digests of a tool's batch."""
        columns = [f.split()[0] for f in self._DIGEST.split(", ")]
        rows = digests.withColumns({"tool": F.lit(tool), "batch_id": F.lit(batch_id).cast("bigint")}).select(*columns)
        rows.write.mode("append").partitionBy("tool", "batch_id").parquet(self._path("session_digest"))

    def digests(self) -> DataFrame:
        """Latest digest per session: the state of a session only grows, so it is the one of the newest turn with the most entries.

        Batch ids are counted per tool and cannot tell.
        """
        log = self.digest_log()
        columns = [c for c in log.columns if c not in ("session_id", "tool", "batch_id")]
        return (
            log.groupBy("session_id")
            .agg(F.max_by(F.struct(*columns), F.struct("timestamp_iso", F.size("progress_entries"), "batch_id")).alias("d"))
            .select("session_id", "d.*")
        )

    def write_documents(self, folder: str) -> None:
        """The latest rendered digests as text, one folder per tool."""
        rows = self.digests().select(F.col("source_tool").alias("tool"), F.col("body").alias("value"))
        rows.write.mode("overwrite").partitionBy("tool").text(folder)

    def write_audit_log(self, folder: str) -> None:
        """Rejected records as JSON lines; a message names the position, never the content."""
        message = F.concat_ws(" ", F.col("reason"), F.lit("at byte"), F.col("end_offset").cast("string"), F.lit("of"), F.col("source_path"))
        rows = self.rejects().select(F.lit("error").alias("level"), "tool", "batch_id", message.alias("message"))
        rows.write.mode("overwrite").json(folder)

    # -- progress and history ----------------------------------------------------------------------------------------------
    def _progress(self) -> DataFrame:
        order = "struct<batch_id:bigint,ts_ms:bigint,source_path:string,end_offset:bigint>"
        return self._read("progress_log", f"project string, entry string, ord {order}, tool string, batch_id bigint")

    def progress_log(self) -> DataFrame:
        return self._progress().select("project", "entry", "ord")

    def _progress_ends(self) -> KeyedTable:
        order = "struct<batch_id:bigint,ts_ms:bigint,source_path:string,end_offset:bigint>"
        return KeyedTable(self.spark, self._path("progress_ends"), f"project string, entry string, ord {order}", ("project",), progress.last_entries)

    def progress_ends(self, touched: DataFrame) -> DataFrame:
        """The last entries of the logs of projects: all a batch has to know of what is logged."""
        return self._progress_ends().read(touched)

    def append_progress(self, rows: DataFrame, tool: str, batch_id: int) -> None:
        """The log is only ever appended to; a batch that is repeated reads what it had written itself, and no other."""
        mine = self._progress().where((F.col("tool") == tool) & (F.col("batch_id") == batch_id))
        fresh = rows.join(mine.select("project", "entry"), ["project", "entry"], "left_anti").select("project", "entry", "ord")
        placed = fresh.withColumns({"tool": F.lit(tool), "batch_id": F.lit(batch_id).cast("bigint")})
        placed.write.mode("append").partitionBy("tool", "batch_id").parquet(self._path("progress_log"))
        written = self._progress().where((F.col("tool") == tool) & (F.col("batch_id") == batch_id))
        self._progress_ends().append(progress.last_entries(written.select("project", "entry", "ord")), tool)

    def _history(self) -> KeyedTable:
        schema = "project string, section string, value string, first_seen_ms bigint"
        fold = lambda rows: rows.groupBy("project", "section", "value").agg(F.min("first_seen_ms").alias("first_seen_ms"))
        return KeyedTable(self.spark, self._path("history"), schema, ("project", "section", "value"), fold)

    def history(self, touched: DataFrame | None = None) -> DataFrame:
        """All of the history, or what shares a bucket with values of ``touched``."""
        return self._history().read(touched)

    def append_history(self, rows: DataFrame, tool: str) -> None:
        self._history().append(rows, tool)

    # -- file activity -----------------------------------------------------------------------------------------------------
    def activity(self) -> DataFrame:
        """``(project, rank, line)`` of the last refresh that found any for the project."""
        log = self._read("activity", "project string, rank int, line string, batch_id bigint")
        newest = log.groupBy("project").agg(F.max("batch_id").alias("batch_id"))
        return log.join(newest, ["project", "batch_id"], "left_semi").select("project", "rank", "line").distinct()

    def append_activity(self, rows: DataFrame, batch_id: int) -> None:
        kept = rows.select("project", "rank", "line", F.lit(batch_id).cast("bigint").alias("batch_id"))
        kept.write.mode("append").parquet(self._path("activity"))

    # -- retention ---------------------------------------------------------------------------------------------------------
    def _trimmed(self) -> KeyedTable:
        fold = lambda rows: rows.groupBy("session_id").agg(F.max("newest_ms").alias("newest_ms"))
        return KeyedTable(self.spark, self._path("trimmed"), "session_id string, newest_ms bigint", ("session_id",), fold)

    def trimmed(self) -> DataFrame:
        """``(session_id, newest_ms)`` of what was removed; a rescan does not bring it back."""
        return self._trimmed().read()

    def drop_sessions(self, old: DataFrame) -> None:
        """Remove sessions ``old(session_id, newest_ms)``: what is derived from their turns first, the turns last, so that a trim that died can be repeated.

        Only partitions and buckets that hold some of them are written anew. Offsets stay, and so do the logs and the history of projects.
        """
        self._trimmed().append(old.select("session_id", "newest_ms"), "retention")
        without = lambda rows: rows.join(old.select("session_id"), "session_id", "left_anti").select(*rows.columns)
        self._session_state().rewrite(without, old)
        self._rewrite("session_digest", self._DIGEST, ["tool", "batch_id"], ["session_id"], old, without)
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NORMALIZED.fields)
        self._rewrite("records", f"{ddl}, batch_id bigint", ["status", "tool", "batch_id"], ["session_id", "ts_ms"], old, without)

    def _rewrite(self, name: str, schema: str, parts: list[str], order: list[str], old: DataFrame, without) -> None:
        table = self._read(name, schema)
        touched = [tuple(r) for r in table.join(old.select("session_id"), "session_id", "left_semi").select(*parts).distinct().collect()]  # a row per partition
        if not touched:
            return
        mine = F.struct(*parts).isin([F.struct(*[F.lit(v).cast(table.schema[c].dataType).alias(c) for c, v in zip(parts, row)]) for row in touched])
        staged = f"{self._path('_trim')}/{uuid.uuid4().hex}"
        without(table.where(mine)).write.parquet(staged)
        kept = self.spark.read.schema(table.schema).parquet(staged)
        left = {tuple(r) for r in kept.select(*parts).distinct().collect()}
        ordered = kept.repartition(*parts).sortWithinPartitions(*parts, *order)
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(self._path(name))
        for row in sorted(set(touched) - left):
            where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self._path(name), *(f"{c}={v}" for c, v in zip(parts, row))]))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
