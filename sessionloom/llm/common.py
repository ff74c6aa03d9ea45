"""Shared by the operators: tables of the shared folder, Arrow columns as byte arrays, word boundaries and hashes.

Python steps take Arrow batches and work on whole columns with numpy; a batch is cut into slices of documents so that working memory
follows ``SLICE_BYTES`` and the longest single text, never the number of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.session import configure, shared_dir

SLICE_BYTES = 1 << 22
#: Fixed value: the blanks of the word pattern ``[^\x20\x09-\x0D]+``.
BLANKS = (0x20, *range(0x09, 0x0E))
IS_BLANK = np.zeros(256, bool)
IS_BLANK[list(BLANKS)] = True


def prepare(spark: SparkSession) -> None:
    """Options of a session that somebody else created: batches for Python are kept small, as texts may be long."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: a table in the shared folder, which outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``rank``, from 1 in the order of some columns that no two rows share: a range sort, stored, and the counts of its parts."""
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The lower bits number the rows of a part, in its order.
    places = {"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    stored = written(cut.withColumns(places), name)
    starts = stored.groupBy("__part").agg(F.count("*").alias("__n")).selectExpr("__part", "sum(__n) over (order by __part) - __n as __start")
    placed = stored.join(F.broadcast(starts), "__part")  # a row per part of the sort
    return placed.withColumn("rank", F.col("__start") + F.col("__place") + 1).drop("__part", "__place", "__start", "__n")


def extend(df: DataFrame, fields: list[T.StructField], make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """Append columns made from whole batches; a column of the same name is replaced."""
    new = {f.name for f in fields}
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([*df.select(*[f"`{c}`" for c in kept]).schema.fields, *fields])
    places = [i for i, c in enumerate(df.columns) if c not in new]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *make(batch)], names=names)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and the offsets of its rows (one more than rows). Nulls are empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows ``[i, j)`` of about ``size`` bytes, one row at least."""
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, rows)
        i = min(j, rows)


def by_slice(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(i, j, bytes, offsets)`` of each slice of a text column."""
    data, offsets = utf8(column)
    for i, j in slices(offsets, size):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other bytes than blanks; none crosses a row), and the first word of each row."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(IS_BLANK[data], out=inside[1:-1])
    starts_at = inside[1:] & ~inside[:-1]
    ends_at = inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut + 1]]
    starts_at[both] = True
    ends_at[both] = True
    starts, ends = np.flatnonzero(starts_at), np.flatnonzero(ends_at)
    return starts, ends, np.searchsorted(starts, offsets)


_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= SLICE_BYTES + 1:
            _POWERS[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_FOLDED_BYTE = _BYTE[FOLD]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over random byte values, read off running sums. ``fold``: ASCII case aside."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED_BYTE if fold else _BYTE)[data] * _powers("up", _BASE, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers("down", _INVERSE, len(data))[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def runs_of_words(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` words in a row and the index of their first word; no run crosses a row."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(hashes) - n + 1
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = (h + hashes[k : k + size]) * np.uint64(0xD1342543DE82EF95) + np.uint64(k + 1)
        h ^= h >> np.uint64(29)
    counts = np.diff(first)
    left = np.repeat(first[1:], counts)[:size] - np.arange(size)
    at = np.flatnonzero(left >= n)
    return mix(h[at]), at


def strings(values: list[str | None]) -> pa.Array:
    return pa.array(values, pa.string())


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values), pa.int64())


def digest(text: str = "text") -> F.Column:
    """128 bits that stand for a whole text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
