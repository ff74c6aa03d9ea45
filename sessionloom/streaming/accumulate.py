"""Accumulation of history and of last values as keyed state (T6, A8, A9): a batch reads the state of its own keys and nothing else.

History: a value of a project's section is new once. State is kept per project, section and part of the values' hashes, so a project that owns most
of the rows is spread over ``PARTS`` keys, and a batch looks up the values it brings. Repeats within a batch are folded to their earliest time before
they are shuffled.

Last values: the newest non-empty value per key; one row of state a key, and folded likewise.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sessionloom.functions import text as tx

PARTS = 64


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(project, section, part, value, ts_ms)`` of a batch, each value once, at its earliest time."""
    for batch in batches:
        keys = ["project", "section", "part", "value"]
        made = pa.Table.from_batches([batch]).group_by(keys).aggregate([("ts_ms", "min")])
        yield from pa.table([*(made.column(c) for c in keys), made.column("ts_ms_min")], names=[*keys, "ts_ms"]).to_batches()


class History(StatefulProcessor):
    """Map state: value to the time it was first seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "value string", "first_seen_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).groupby("value")["ts_ms"].min()
        fresh = [(v, int(ts)) for v, ts in new.items() if not self.seen.containsKey((v,))]
        for v, ts in fresh:
            self.seen.updateValue((v,), (ts,))
        if fresh:
            yield pd.DataFrame([(key[0], key[1], v, ts) for v, ts in fresh], columns=["project", "section", "value", "first_seen_ms"])

    def close(self) -> None:
        pass


def history_stream(values: DataFrame) -> DataFrame:
    """``(project, section, value, first_seen_ms)`` of first lines no batch had before, of a stream ``(project, section, value, ts_ms)``. Empty values and
    ``<no …>`` placeholders never enter."""
    line = tx.first_line(F.col("value"))
    known = values.select("project", "section", line.alias("value"), F.col("ts_ms").cast("bigint").alias("ts_ms"))
    kept = known.where((F.col("value") != "") & ~F.startswith("value", F.lit("<no ")))
    dealt = kept.select("project", "section", F.pmod(F.xxhash64("value"), F.lit(PARTS)).cast("int").alias("part"), "value", "ts_ms")
    folded = dealt.mapInArrow(_earliest, dealt.schema)
    out = "project string, section string, value string, first_seen_ms bigint"
    return folded.groupBy("project", "section", "part").transformWithStateInPandas(History(), out, "Append", "None")


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch's rows ``(key, value, ord)`` the one of the largest order per key."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).to_pandas()
        if len(rows):
            best = rows.sort_values(["ord", "value"]).drop_duplicates("key", keep="last")
            yield from pa.Table.from_pandas(best, schema=batch.schema, preserve_index=False).to_batches()


class LastValue(StatefulProcessor):
    """Value state: the newest value and its order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string, ord bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["ord", "value"]).iloc[-1]
        before = self.last.get() if self.last.exists() else None
        if before is None or (int(new["ord"]), new["value"]) > (before[1], before[0]):
            self.last.update((new["value"], int(new["ord"])))
            yield pd.DataFrame([(key[0], new["value"], int(new["ord"]))], columns=["key", "value", "ord"])

    def close(self) -> None:
        pass


def last_value_stream(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``(key, value, ord)`` whenever a key's newest non-empty value changes."""
    slim = rows.select(F.col(key).cast("string").alias("key"), F.col(value).alias("value"), F.col(order).cast("bigint").alias("ord"))
    kept = slim.where((F.coalesce("value", F.lit("")) != "") & F.col("ord").isNotNull())
    return kept.mapInArrow(_newest, kept.schema).groupBy("key").transformWithStateInPandas(LastValue(), "key string, value string, ord bigint", "Update", "None")


def start_accumulation(found: DataFrame, folder: str, mode: str = "append", *, available_now: bool = False, interval: str = "10 seconds") -> StreamingQuery:
    """Write what is new below ``folder``, a partition per batch that a repeated batch replaces."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch_id}")

    writer = found.writeStream.foreachBatch(one_batch).outputMode(mode).option("checkpointLocation", f"{folder}/state")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


# Ship this module's processors with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
