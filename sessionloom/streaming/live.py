"""Live idle sessions that lose no event (T4): keyed state, updates of open sessions, late rows kept beside.

A micro-batch is folded to intervals one gap wide in the tasks that read it, so a hot key sends its state few rows however many events it has. The
state of a key holds its recent sessions; a batch merges its intervals into them and emits every session that changed, open ones included. A session
keeps its number while it grows; if two grow together the later number is emitted with no events.

Sessions that ended more than the gap and the allowed lateness before the key's newest event leave the state. An interval that may touch one that
left is late: it is emitted as such, not dropped, and ``all_sessions`` merges late intervals with the sessions they touch. So reading is exact at any
time, whatever order events came in, and state is bounded by the lateness.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sessionloom.operators.windows import IDLE_GAP_SECONDS
from sessionloom.session import configure

SESSION, LATE = "session", "late"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEPT = "uid bigint, first_us bigint, last_us bigint, n bigint"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own, so that the caller's options stay as they are; keyed state needs this store."""
    own = configure(spark.newSession())
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def _fold(gap_us: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Intervals of events that lie in the same cell one gap wide; two such events are always of one session."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us = batch.column(1).to_numpy()
            cells = pa.table([batch.column(0), pa.array(us), pa.array(us - us % gap_us)], names=["key", "us", "cell"])
            made = cells.group_by(["key", "cell"]).aggregate([("us", "min"), ("us", "max"), ("us", "count")])
            columns = [made.column(c) for c in ("key", "us_min", "us_max", "us_count")]
            yield from pa.table(columns, names=["key", "first_us", "last_us", "n"]).to_batches()

    return run


def merge_intervals(rows: list[tuple[int, int, int, int | None]], gap_us: int) -> list[tuple[int, int, int, list[int]]]:
    """``(first, last, n, uid or None)`` merged to ``(first, last, n, uids)``: intervals nearer than the gap are one session."""
    out: list[tuple[int, int, int, list[int]]] = []
    for first, last, n, uid in sorted(rows, key=lambda r: r[:2]):
        uids = [] if uid is None else [uid]
        if out and first - out[-1][1] < gap_us:
            a, b, m, known = out[-1]
            out[-1] = (a, max(b, last), m + n, known + uids)
        else:
            out.append((first, last, n, uids))
    return out


class IdleSessions(StatefulProcessor):
    """State per key: recent sessions, the next number, the newest event and the end of what has left the state."""

    def __init__(self, key: str, gap_us: int, lateness_us: int):
        self.key, self.gap, self.lateness = key, gap_us, lateness_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getListState("sessions", _KEPT)
        self.meta = handle.getValueState("meta", "next_uid bigint, high_us bigint, floor_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        next_uid, high, floor = self.meta.get() if self.meta.exists() else (0, None, None)
        before = {s[0]: (s[1], s[2], s[3]) for s in self.sessions.get()} if self.sessions.exists() else {}
        intervals = [(int(r.first_us), int(r.last_us), int(r.n)) for r in new.itertuples()]
        late = [r for r in intervals if floor is not None and r[0] < floor]
        fresh = [(*r, None) for r in intervals if floor is None or r[0] >= floor]
        out = [(LATE, None, *r) for r in late]
        kept = []
        for first, last, n, uids in merge_intervals([(*v, uid) for uid, v in before.items()] + fresh, self.gap):
            if not uids:
                uids, next_uid = [next_uid], next_uid + 1
            uid = min(uids)
            if before.get(uid) != (first, last, n):
                out.append((SESSION, uid, first, last, n))
            out.extend((SESSION, gone, first, last, 0) for gone in uids if gone != uid)
            high = last if high is None else max(high, last)
            kept.append((uid, first, last, n))
        over = [s for s in kept if s[2] + self.gap + self.lateness <= high] if high is not None else []
        if over:
            floor = max([s[2] + self.gap for s in over] + ([] if floor is None else [floor]))
        self.sessions.put([s for s in kept if s not in over])
        self.meta.update((next_uid, high, floor))
        if out:
            made = pd.DataFrame(out, columns=["kind", "uid", "first_us", "last_us", "n_events"]).astype({"uid": "Int64"})
            made.insert(0, self.key, key[0])
            yield made

    def close(self) -> None:
        pass


def session_updates(events: DataFrame, key: str, ts: str, gap_seconds: int = IDLE_GAP_SECONDS, lateness_seconds: int = 600) -> DataFrame:
    """``(key, kind, uid, first_us, last_us, n_events)`` per micro-batch, in update mode. Events without a time belong to no session."""
    gap_us = gap_seconds * 1_000_000
    kind = events.schema[key].dataType
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    slim = events.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), us.alias("us"))
    longs = [T.StructField(c, T.LongType()) for c in ("first_us", "last_us", "n")]
    folded = slim.mapInArrow(_fold(gap_us), T.StructType([T.StructField("key", kind), *longs]))
    out = T.StructType([T.StructField(key, kind), T.StructField("kind", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("uid", "first_us", "last_us", "n_events")]])
    processor = IdleSessions(key, gap_us, lateness_seconds * 1_000_000)
    return folded.groupBy("key").transformWithStateInPandas(processor, out, "Update", "None")


def start_idle_sessions(updates: DataFrame, folder: str, *, available_now: bool = False, interval: str = "10 seconds") -> StreamingQuery:
    """Write the updates below ``folder``, a partition per batch that a repeated batch replaces."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch_id={batch_id}")

    writer = updates.writeStream.foreachBatch(one_batch).outputMode("update").option("checkpointLocation", f"{folder}/state")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def all_sessions(updates: DataFrame, key: str, gap_seconds: int = IDLE_GAP_SECONDS) -> DataFrame:
    """``(key, session_start, session_end, n_events)`` from all updates so far, ``updates`` having ``batch_id``: the last word on each session, and late
    intervals merged into what they touch."""
    latest = updates.where(F.col("kind") == SESSION).groupBy(key, "uid").agg(F.max_by(F.struct("first_us", "last_us", "n_events"), "batch_id").alias("s"))
    found = latest.select(key, "s.*").unionByName(updates.where(F.col("kind") == LATE).select(key, "first_us", "last_us", "n_events")).where("n_events > 0")
    w = Window.partitionBy(key).orderBy("first_us", "last_us")
    so_far = F.max("last_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(so_far.isNull() | (F.col("first_us") - so_far >= gap_seconds * 1_000_000), 1).otherwise(0)
    numbered = found.withColumn("starts", starts).withColumn("no", F.sum("starts").over(w))
    whole = numbered.groupBy(key, "no").agg(F.min("first_us").alias("a"), F.max("last_us").alias("b"), F.sum("n_events").alias("n_events"))
    return whole.select(key, F.timestamp_micros("a").alias("session_start"), F.timestamp_micros("b").alias("session_end"), "n_events")


def late_intervals(updates: DataFrame, key: str) -> DataFrame:
    """The side table: what came too late for the state, as intervals of events."""
    rows = updates.where(F.col("kind") == LATE)
    return rows.select(key, F.timestamp_micros("first_us").alias("first"), F.timestamp_micros("last_us").alias("last"), "n_events", "batch_id")


# Ship this module's processor with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
