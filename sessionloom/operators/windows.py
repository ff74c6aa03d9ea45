"""Ordered operators that stay distributed when one key owns most of the rows.

A plain window over a key is one task per key. Both operators here first cut the order axis into cells, do the row-level work
inside a cell, and carry state between the cells of a key through a table of cell summaries whose size depends on the length of
the axis, not on the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDLE_GAP_SECONDS = 300
SEGMENT_BYTES = 32 * 1024 * 1024


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _cell(c: Column, width: int) -> Column:
    """Start of the cell a whole number falls in; integer arithmetic only."""
    return c - F.pmod(c, F.lit(width).cast("bigint"))


def _idle_cells(events: DataFrame, key: str, ts: str, gap_us: int) -> DataFrame:
    """Events folded to cells one gap wide. Two events of one cell are less than a gap apart, so a cell never spans a session
    border, and a key has at most (time span / gap) cells however many events it has."""
    us = _micros(F.col(ts))
    cells = (
        events.groupBy(F.col(key), _cell(us, gap_us).alias("cell"))
        .agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy(key).orderBy("cell")
    before = F.lag("last_us").over(w)
    starts = F.when(before.isNull() | (F.col("first_us") - before >= gap_us), 1).otherwise(0)
    return cells.withColumn("starts", starts).withColumn("session_no", F.sum("starts").over(w))


def idle_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int = IDLE_GAP_SECONDS) -> DataFrame:
    """Sessions of a key (W6): a gap of ``gap_seconds`` or more starts a new one."""
    cells = _idle_cells(events, key, ts, gap_seconds * 1_000_000)
    as_given = events.schema[ts].dataType
    return cells.groupBy(key, "session_no").agg(
        F.timestamp_micros(F.min("first_us")).cast(as_given).alias("session_start"),
        F.timestamp_micros(F.max("last_us")).cast(as_given).alias("session_end"),
        F.sum("n").alias("n_events"),
    )


def assign_idle_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int = IDLE_GAP_SECONDS) -> DataFrame:
    """Every event with the number of its session. The join key includes the cell, which spreads a hot key."""
    gap_us = gap_seconds * 1_000_000
    cells = _idle_cells(events, key, ts, gap_us).select(key, "cell", "session_no")
    tagged = events.withColumn("cell", _cell(_micros(F.col(ts)), gap_us))
    return tagged.join(cells, [key, "cell"]).drop("cell")


def carry_forward(
    df: DataFrame,
    key: str,
    order: str,
    value: Column,
    out: str,
    segment_width: int = SEGMENT_BYTES,
    marks: DataFrame | None = None,
) -> DataFrame:
    """Latest non-null ``value`` at or before each row of a key (J1), in the order of a whole-number column.

    Rows are windowed per (key, segment of the order axis); a segment's own first rows take the last value of the segments
    before it from the summary table. For byte offsets a segment is a bounded number of bytes.

    ``marks(key, order, value)`` may give the same rows in a cheaper form for the summary, which is computed apart.
    """
    segment = _cell(F.col(order).cast("bigint"), segment_width)
    rows = df.withColumn("__value", value).withColumn("__segment", segment)
    inside = Window.partitionBy(key, "__segment").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__local", F.last("__value", ignorenulls=True).over(inside))
    summary = rows if marks is None else marks.withColumnRenamed("value", "__value").withColumn("__segment", segment)
    summary = summary.groupBy(key, "__segment").agg(
        F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("__last")
    )
    before = Window.partitionBy(key).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(key, "__segment", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    joined = local.join(carried, [key, "__segment"], "left")
    return joined.withColumn(out, F.coalesce("__local", "__carried")).drop(
        "__value", "__segment", "__local", "__carried"
    )
