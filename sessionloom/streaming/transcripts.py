"""Continuous ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionloom.plans import ingest
from sessionloom.session import configure
from sessionloom.sources import jsonl, tail
from sessionloom.sources.tables import Warehouse


def transcript_stream(spark: SparkSession, path: str, glob: str = "*.jsonl", max_bytes: int = 64 * 1024**3) -> DataFrame:
    """Lines of transcript files as they land. A file is read once; a writer that appends should land each piece as a file."""
    reader = (
        spark.readStream.format("text")
        .option("lineSep", "\n")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .option("maxBytesPerTrigger", str(max_bytes))
    )
    return jsonl.with_positions(reader.load(path))


def start_ingest(
    warehouse: Warehouse, lines: DataFrame, tool: str, checkpoint: str, *, available_now: bool = False, interval: str = "30 seconds"
) -> StreamingQuery:
    """Every micro-batch goes through the batch ingest; the checkpoint replays a failed batch under the same id, and
    stored positions make the replay add nothing."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        scoped = Warehouse(configure(batch.sparkSession), warehouse.root)
        ingest.ingest_lines(scoped, batch, tool, batch_id)

    writer = lines.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def start_tail_ingest(
    warehouse: Warehouse, tool: str, path: str, checkpoint: str, *, glob: str = "*.jsonl", available_now: bool = False, interval: str = "30 seconds"
) -> StreamingQuery:
    """T1 for files that grow in place: every trigger reads the bytes that were appended since the last one, and nothing else."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        scoped = Warehouse(configure(batch.sparkSession), warehouse.root)
        ingest.ingest_raw(scoped, tail.as_raw(batch, tool), tool, batch_id)

    writer = tail.tail_stream(warehouse.spark, path, glob).writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def ingest_on_signals(
    warehouse: Warehouse, signals: DataFrame, roots: dict[str, str], checkpoint: str, *, glob: str = "*.jsonl", available_now: bool = False
) -> StreamingQuery:
    """Entry of hook and watch notifications: a batch of signals reads what is new for the tools it names.

    ``roots`` maps a tool to its transcript folder. A signal that asks for a rescan (T8) makes every tool read from the start;
    stored positions keep that from adding anything twice.
    """
    order = sorted(roots)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        scoped = Warehouse(configure(batch.sparkSession), warehouse.root)
        rescan = not batch.filter("rescan").isEmpty()
        # At most one row per configured tool comes to the driver.
        named = {r["tool"] for r in batch.filter(F.col("tool").isin(order)).select("tool").distinct().collect()}
        for tool in order:
            if rescan or tool in named:
                ingest.ingest_path(scoped, tool, roots[tool], batch_id, full_refresh=rescan, glob=glob)

    writer = signals.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    return writer.start()


def poll_growing_files(
    warehouse: Warehouse, tool: str, path: str, checkpoint: str, interval: str = "30 seconds"
) -> StreamingQuery:
    """For files that grow in place: a clock drives the incremental batch read, whose offsets live in the warehouse."""
    clock = warehouse.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def one_tick(_: DataFrame, batch_id: int) -> None:
        ingest.ingest_path(warehouse, tool, path, batch_id)

    return (
        clock.writeStream.foreachBatch(one_tick).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
    )
