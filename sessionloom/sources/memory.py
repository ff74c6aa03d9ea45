"""Records given as values (S14), for tests and small corrections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from sessionloom.schemas import RAW


def records(spark: SparkSession, tool: str, source_path: str, lines: Iterable[str]) -> DataFrame:
    """``raw`` records of one source, with the byte offsets the lines would have in a file."""
    rows, end = [], 0
    for line in lines:
        start, end = end, end + len(line.encode()) + 1
        rows.append((tool, source_path, start, end, line, True))
    return spark.createDataFrame(rows, RAW)
