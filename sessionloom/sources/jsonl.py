"""Line sources with exact byte offsets."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.schemas import RAW

_LINES = T.StructType(
    [
        T.StructField("source_path", T.StringType()),
        T.StructField("split_start", T.LongType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("line", T.StringType()),
        T.StructField("end_in_split", T.LongType()),
        T.StructField("context", T.StringType()),
    ]
)
_TOTALS = "source_path string, split_start bigint, bytes bigint, seq bigint, context string"

# One row per split of the input: a million rows stand for more than 100 TB at the default split size.
MAX_BROADCAST_SPLITS = 1_000_000


@dataclass(frozen=True)
class Context:
    """A value some lines open for the lines after them: ``opens`` reads it from a line that contains ``needle``."""

    needle: str
    opens: Callable[[str], str | None]


def _opened_session(line: str) -> str | None:
    try:
        record = json.loads(line)
    except ValueError:
        return None
    if not isinstance(record, dict) or record.get("type") != "session_meta":
        return None
    payload = record.get("payload")
    inner = payload.get("id") if isinstance(payload, dict) else None
    for value in (inner, record.get("session_id")):
        if isinstance(value, str):
            return value
    return None


SESSION_CONTEXT = Context("session_meta", _opened_session)


def _opened(lines: pa.Array, context: Context | None) -> tuple[np.ndarray, list[str]]:
    """Rows that open a context, and what they open. Only lines with the needle are looked at."""
    rows, values = [], []
    if context is not None:
        hit = pc.fill_null(pc.match_substring(lines, context.needle), False)
        for i in np.flatnonzero(hit.to_numpy(zero_copy_only=False)):
            value = context.opens(lines[int(i)].as_py())
            if value is not None:
                rows.append(int(i))
                values.append(value)
    return np.array(rows, dtype=np.int64), values


def _split_firsts(batch: pa.RecordBatch) -> np.ndarray:
    """Rows at which another split begins."""
    path, start = batch.column("source_path"), batch.column("split_start")
    changed = np.ones(batch.num_rows, dtype=bool)
    if batch.num_rows > 1:
        differs = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1]))
        changed[1:] = differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed)


def _running(context: Context | None):
    """Running byte count and open context within each file split.

    A task reads its splits one after the other and in order, so neither needs a shuffle: both restart where the split changes
    and go on over batch borders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, carried_bytes, carried_context = None, 0, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            path, start, lines = (batch.column(c) for c in ("source_path", "split_start", "line"))
            size = pc.add(pc.binary_length(lines).cast(pa.int64()), 1).to_numpy(zero_copy_only=False)
            firsts = _split_firsts(batch)
            lengths = np.diff(np.append(firsts, n))
            total = np.cumsum(size)
            end = total - np.repeat(total[firsts] - size[firsts], lengths)

            rows, values = _opened(lines, context)
            nth = np.searchsorted(rows, np.arange(n), side="right") - 1
            at = np.where(nth >= 0, rows[np.maximum(nth, 0)] if len(rows) else -1, -1)
            nth = np.where(at >= np.repeat(firsts, lengths), nth, -1)

            if (path[0].as_py(), start[0].as_py()) == last_key:
                head = lengths[0]
                end[:head] += carried_bytes
                if carried_context is not None:
                    values = [*values, carried_context]
                    nth[:head] = np.where(nth[:head] < 0, len(values) - 1, nth[:head])
            opened = pa.array(values, pa.string()).take(pa.array(nth, mask=nth < 0))
            last_key = (path[-1].as_py(), start[-1].as_py())
            carried_bytes, carried_context = int(end[-1]), opened[-1].as_py()
            columns = [batch.column(c) for c in ("source_path", "split_start", "file_size", "line")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(end), opened], names=_LINES.fieldNames())

    return run


def _totals(context: Context | None):
    """Bytes and last opened context of each split, per batch; ``seq`` orders the batches of a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            firsts = _split_firsts(batch)
            sums = np.add.reduceat(batch.column("size").to_numpy(zero_copy_only=False), firsts)
            rows, values = _opened(batch.column("opener"), context)
            last = np.searchsorted(rows, np.append(firsts[1:], n), side="left") - 1
            inside = (last >= 0) & (rows[np.maximum(last, 0)] >= firsts if len(rows) else False)
            opened = pa.array(values, pa.string()).take(pa.array(last, mask=~inside))
            columns = [batch.column(c).take(pa.array(firsts)) for c in ("source_path", "split_start")]
            order = pa.array(np.arange(seq, seq + len(firsts)))
            seq += len(firsts)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sums), order, opened], names=["source_path", "split_start", "bytes", "seq", "context"]
            )

    return run


def _splits_fit_broadcast(lines: DataFrame) -> bool:
    """Is the table of splits small? Each split that starts inside a file follows a full-sized one, and a full-sized split fills a
    partition, so there are no more of them than partitions, which are known before anything runs."""
    return lines.rdd.getNumPartitions() <= MAX_BROADCAST_SPLITS


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = "*.jsonl", **options: str) -> DataFrame:
    """Lines with their file and split. Only a newline ends a line; a carriage return stays part of it, so bytes add up."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return with_positions(reader.text(path))


def with_positions(text: DataFrame) -> DataFrame:
    """File, split and size columns for a batch or streaming text source."""
    meta = F.col("_metadata")
    return text.select(
        meta["file_path"].alias("source_path"),
        meta["file_block_start"].alias("split_start"),
        meta["file_size"].alias("file_size"),
        F.col("value").alias("line"),
    )


def scan_jsonl(lines: DataFrame, tool: str, mode: str = "PERMISSIVE", context: Context | None = None) -> DataFrame:
    """``raw`` records with exact end offsets, and J1: the context open at each record.

    Offsets are a two-level prefix sum: bytes within a split (in the task that reads it) plus the bytes of the splits before it
    (one row per split). A context opened in an earlier split comes the same way. A file of any size spreads over its splits, and
    no line is shuffled; the split totals take a second pass that only measures line lengths. Both passes sit behind an Arrow
    step, so no filter can reach one scan and not the other: the split borders depend on the files a scan selects and must be
    the same in both.

    An unterminated last line is not a record yet. ``PERMISSIVE`` leaves it for a later read; ``FAILFAST`` fails with its start
    offset and none of its content.
    """
    counted = lines.select("source_path", "split_start", "file_size", "line").mapInArrow(_running(context), _LINES)
    size = (F.octet_length("line") + F.lit(1)).cast("bigint")
    opener = F.lit(None).cast("string") if context is None else F.when(F.contains("line", F.lit(context.needle)), F.col("line"))
    totals = (
        lines.select("source_path", "split_start", size.alias("size"), opener.alias("opener"))
        .mapInArrow(_totals(context), _TOTALS)
        .groupBy("source_path", "split_start")
        .agg(
            F.sum("bytes").alias("bytes"),
            F.max_by("context", F.when(F.col("context").isNotNull(), F.col("seq"))).alias("context"),
        )
    )
    before = Window.partitionBy("source_path").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "source_path",
        "split_start",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"),
        F.last("context", ignorenulls=True).over(before).alias("earlier"),
    )
    # A split that starts at byte zero has nothing before it, so files of one split (nearly all) need no partner row.
    bases = bases.filter("split_start > 0")
    if _splits_fit_broadcast(lines):
        bases = F.broadcast(bases)
    end = F.col("end_in_split") + F.coalesce("base", F.lit(0))
    raw = counted.join(bases, ["source_path", "split_start"], "left").select(
        F.lit(tool).alias("tool"),
        "source_path",
        (end - F.octet_length("line") - 1).cast("bigint").alias("start_offset"),
        end.cast("bigint").alias("end_offset"),
        "line",
        (end <= F.col("file_size")).alias("is_complete"),
        F.coalesce("context", "earlier").alias("context_session_id"),
    )
    if mode == "FAILFAST":
        message = F.concat(F.lit("partial line at byte "), F.col("start_offset").cast("string"))
        checked = F.when(F.col("is_complete"), True).otherwise(F.raise_error(message).cast("boolean"))
        raw = raw.withColumn("is_complete", checked)
    kept = RAW.fieldNames() if context is None else [*RAW.fieldNames(), "context_session_id"]
    return raw.filter("is_complete").select(*kept)


def scan_path(
    spark: SparkSession, tool: str, path: str | list[str], mode: str = "PERMISSIVE", glob: str | None = "*.jsonl", **options: str
) -> DataFrame:
    """Scan a transcript tree. ``modifiedAfter`` skips files that did not change since an earlier read before they are opened."""
    context = SESSION_CONTEXT if tool == "codex" else None
    return scan_jsonl(read_lines(spark, path, glob, **options), tool, mode, context)


def list_sources(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """``source_path, project, size, mtime`` of every transcript. Only the listing is read, not the files."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return listed.select(
        F.col("path").alias("source_path"),
        F.element_at(F.split("path", "/"), -2).alias("project"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    )


def grown_sources(spark: SparkSession, path: str | list[str], offsets: DataFrame, glob: str | None = "*.jsonl") -> list[str]:
    """The files below ``path`` that hold more bytes than ``offsets(source_path, byte_offset)`` knows, as patterns to read.

    Only the listing is read. The result names the files that changed; the reader lists them on the driver too.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    sizes = listed.select(F.col("_metadata.file_path").alias("source_path"), "path", F.col("length").alias("size"))
    grown = sizes.join(offsets.select("source_path", "byte_offset"), "source_path", "left").filter(F.col("size") > F.coalesce("byte_offset", F.lit(0)))
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]) for r in grown.select("path").orderBy("path").collect()]


# Ship this module's task functions with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
