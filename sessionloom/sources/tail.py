"""Growing line files read from a byte on: the batch read (S1, I1) and the streaming source.

A file is read in ranges of bytes. A line belongs to the range that holds its newline, so ranges can be cut anywhere, a file of any size spreads over
tasks, and a last line without its newline belongs to none: it stays for a later read. A task knows the byte it starts at, so offsets are exact in one
pass. Bytes before a range are touched only to find the beginning of a line that the range ends: none if the byte before it is a newline.

Files are opened by ``pyarrow.fs``; ``reachable`` tells whether it knows a store. Others are left to the scan in ``jsonl``.
"""

from __future__ import annotations

import fnmatch
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sessionloom.operators.sizes import broadcast_if_small
from sessionloom.schemas import RAW

SPLIT_BYTES = 64 << 20
CHUNK = 1 << 20  # a task holds a few copies of it: as read, joined, cut into lines, as Arrow columns
BATCH_LINES = 10_000
SAFE = "/!$&'()*+,;=:@~"  # what a path of Spark's leaves as it is
_ROWS = "source_path string, range_begin bigint, start_offset bigint, end_offset bigint, line binary"
_NAMES = ["source_path", "range_begin", "start_offset", "end_offset", "line"]


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark resolves it to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = urlsplit(where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString())
    return f"{found.scheme}://{found.netloc}{found.path}"


def reachable(uri: str) -> bool:
    """Can tasks open files of this store themselves?"""
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


class _File:
    """An open file that counts what is read from it."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file, self.bytes = system.open_input_file(path), 0

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        self.bytes += len(data)
        return data

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def _head(file: _File, begin: int) -> bytes:
    """What a line that goes on at ``begin`` has before it."""
    parts, at, size = [], begin, 1
    while at > 0:
        size = min(size, at)
        data = file.read(at - size, size)
        cut = data.rfind(b"\n") + 1
        parts.append(data[cut:])
        if cut:
            break
        at -= size
        size = min(max(4096, 2 * size), CHUNK)
    return b"".join(reversed(parts))


def _lines(file: _File, path: str, begin: int, end: int, strict: bool) -> Iterator[pa.RecordBatch]:
    """Lines whose newline lies in ``[begin, end)``. ``strict``: the end is that of the file, and bytes behind the last newline are an error."""
    pending: list[bytes] = []  # an open line, in pieces
    opened, head = begin, None  # where the open line starts; not known before the first newline of a range that begins inside a line
    at = begin
    while at < end:
        data = file.read(at, min(CHUNK, end - at))
        if not data:
            break  # the file was cut since it was listed
        found = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        if len(found):
            if head is None:
                head = _head(file, begin)
                opened -= len(head)
                pending.insert(0, head)
            whole, rest = data[: found[-1]], data[found[-1] + 1 :]
            lines = b"".join([*pending, whole]).split(b"\n")
            ends = found.astype(np.int64) + at + 1
            starts = np.r_[opened, ends[:-1]]
            for k in range(0, len(lines), BATCH_LINES):
                part = slice(k, k + BATCH_LINES)
                n = len(lines[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n), pa.array(np.full(n, begin)), pa.array(starts[part]), pa.array(ends[part]), pa.array(lines[part], pa.binary())], names=_NAMES
                )
            pending, opened = [rest] if rest else [], int(ends[-1])
        else:
            pending.append(data)
        at += len(data)
    if strict and pending:
        raise ValueError(f"partial line at byte {opened if head is not None else opened - len(_head(file, begin))}")


def _read_ranges(strict: bool, counter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, end, size in zip(*(batch.column(c).to_pylist() for c in ("source_path", "range_begin", "range_end", "size"))):
                with _File(path) as file:
                    yield from _lines(file, path, begin, end, strict and end == size)
                    if counter is not None:
                        counter.add(file.bytes)

    return run


def list_sizes(spark: SparkSession, path: str | list[str], glob: str | None = "*.jsonl") -> DataFrame:
    """``(source_path, size)`` of the files below a path. Only the listing is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return listed.select(F.col("_metadata.file_path").alias("source_path"), F.col("length").alias("size"))


def new_ranges(sizes: DataFrame, offsets: DataFrame | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(source_path, range_begin, range_end, size)`` of what lies past ``offsets(source_path, byte_offset)``, in ranges of bounded length."""
    known = sizes.withColumn("byte_offset", F.lit(0)) if offsets is None else sizes.join(offsets.select("source_path", "byte_offset"), "source_path", "left")
    begin = F.coalesce("byte_offset", F.lit(0)).cast("bigint")
    grown = known.select("source_path", "size", begin.alias("begin")).where("size > begin")
    cut = grown.withColumn("range_begin", F.explode(F.sequence("begin", F.col("size") - 1, F.lit(split_bytes).cast("bigint"))))
    return cut.select("source_path", "range_begin", F.least(F.col("range_begin") + split_bytes, F.col("size")).alias("range_end"), "size")


def read_ranges(ranges: DataFrame, strict: bool = False, counter=None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of ranges, each with the range it was read in. ``counter``: an accumulator for the bytes that were read.

    Rows of ranges are small, so the number of tasks follows from their bytes, not from theirs.
    """
    spark = ranges.sparkSession
    total = ranges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("range_end") - F.col("range_begin")), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(total.n, spark.sparkContext.defaultParallelism), -(-total.bytes // split_bytes))
    spread = ranges.select("source_path", "range_begin", "range_end", "size").repartition(tasks, "source_path", "range_begin")
    return spread.mapInArrow(_read_ranges(strict, counter), _ROWS)


def as_raw(lines: DataFrame, tool: str) -> DataFrame:
    """Records of lines; bytes are taken as they are."""
    kept = {"tool": F.lit(tool), "line": F.col("line").cast("string"), "is_complete": F.lit(True)}
    return lines.withColumns(kept).select(*RAW.fieldNames(), *[c for c in ("context_session_id",) if c in lines.columns])


def _fill_forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ``opened`` (last column) by the latest value at or before each line of its range. A task reads a range in order."""
    key, carried = None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        path, begin, opened = batch.column("source_path"), batch.column("range_begin").to_numpy(), batch.column("opened")
        changed = np.r_[True, begin[1:] != begin[:-1]]
        changed[1:] |= pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False)
        first = np.maximum.accumulate(np.where(changed, np.arange(n), 0))
        latest = np.maximum.accumulate(np.where(opened.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1))
        known = latest >= first
        values = opened.take(pa.array(np.where(known, latest, 0), mask=~known))
        if (path[0].as_py(), int(begin[0])) == key and carried is not None:
            goes_on = int(np.argmin(first == 0)) if (first != 0).any() else n
            values = pa.concat_arrays([pc.fill_null(values[:goes_on], carried), values[goes_on:]])
        key, carried = (path[-1].as_py(), int(begin[-1])), values[-1].as_py()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=batch.schema.names)


def with_context(lines: DataFrame, ranges: DataFrame, offsets: DataFrame | None, opened: Column) -> DataFrame:
    """Add ``context_session_id``, the value ``opened`` had last at or before a line of its file.

    Lines of a range get it in the task that reads them. What earlier ranges opened comes from a second look at those files alone that have several
    ranges, and what earlier reads opened from the offsets: a row per range, joined to the lines.
    """
    filled = lines.withColumn("opened", opened).mapInArrow(_fill_forward, f"{_ROWS}, opened string")
    several = ranges.groupBy("source_path").agg(F.count("*").alias("n")).where("n > 1").select("source_path")
    large = ranges.join(several, "source_path", "left_semi")
    last = None
    if not large.isEmpty():
        last = read_ranges(large).withColumn("opened", opened).where("opened is not null").groupBy("source_path", "range_begin")
        last = last.agg(F.max_by("opened", "end_offset").alias("last"))
    known = ranges.select("source_path", "range_begin")
    known = known.withColumn("last", F.lit(None).cast("string")) if last is None else known.join(last, ["source_path", "range_begin"], "left")
    before = Window.partitionBy("source_path").orderBy("range_begin").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("earlier", F.last("last", ignorenulls=True).over(before)).drop("last")
    if offsets is not None:
        seeds = offsets.select("source_path", F.col("last_session_id").alias("seed"))
        known = known.join(seeds, "source_path", "left").withColumn("earlier", F.coalesce("earlier", "seed")).drop("seed")
    found = filled.join(broadcast_if_small(known.where("earlier is not null")), ["source_path", "range_begin"], "left")
    return found.withColumn("context_session_id", F.coalesce("opened", "earlier")).drop("opened", "earlier")


def read_new(
    spark: SparkSession, tool: str, path: str | list[str], offsets: DataFrame | None = None, glob: str | None = "*.jsonl", *, strict: bool = False,
    opened: Column | None = None, counter=None, split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """``raw`` records past the offsets of their files; the bytes before are not read. ``opened`` adds the context (J1), an expression on ``line``."""
    ranges = new_ranges(list_sizes(spark, path, glob), offsets, split_bytes)
    lines = read_ranges(ranges, strict, counter, split_bytes)
    if opened is not None:
        lines = with_context(lines, ranges, offsets, opened)
    return as_raw(lines, tool)


# -- streaming ------------------------------------------------------------------------------------------------------------------
@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads."""

    ranges: list[tuple[str, int, int]]


class TailReader(DataSourceStreamReader):
    """Offset: the bytes of each file that a trigger may look at. Their sum of ranges is cut into tasks of about ``splitBytes``."""

    def __init__(self, options: dict[str, str]):
        self.root, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = fs.FileSystem.from_uri(self.root)
        parts = urlsplit(self.root)
        prefix = f"{parts.scheme}://{'' if parts.scheme == 'file' else parts.netloc}"
        listed = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        named = [x for x in listed if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.glob) and not x.base_name.startswith(("_", "."))]
        return {f"{prefix}{quote(x.path, safe=SAFE)}": x.size for x in sorted(named, key=lambda x: x.path)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        out, held, size = [], [], 0
        for path, stop in end.items():
            for begin in range(start.get(path, 0), stop, self.split):
                upto = min(begin + self.split, stop)
                if held and size + upto - begin > self.split:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append((path, begin, upto))
                size += upto - begin
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, begin, end in partition.ranges:
            with _File(path) as file:
                yield from _lines(file, path, begin, end, False)

    def commit(self, end: dict) -> None:
        """Nothing is kept outside of the checkpoint."""


class TailBatchReader(DataSourceReader):
    """All complete lines there are."""

    def __init__(self, options: dict[str, str]):
        self.stream = TailReader(options)

    def partitions(self) -> list[Ranges]:
        return self.stream.partitions({}, self.stream.latestOffset())

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return self.stream.read(partition)


class TailSource(DataSource):
    """``spark.readStream.format("session_tail")`` over a folder of files that grow. Options: ``path``, ``glob``, ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "session_tail"

    def schema(self) -> str:
        return _ROWS

    def reader(self, schema) -> DataSourceReader:
        return TailBatchReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(dict(self.options))


def tail_stream(spark: SparkSession, path: str, glob: str = "*.jsonl", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream of lines past what earlier triggers read. A trigger lists the folder; the checkpoint keeps a number per file."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("session_tail").option("glob", glob).option("splitBytes", str(split_bytes)).load(qualified(spark, path))


# Ship this module's task functions and the source with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
