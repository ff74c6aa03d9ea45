"""Live sessions in micro-batches that come in any order."""

import random
from datetime import timedelta, timezone

import pytest
from test_windows import START, make_events

from sessionloom.operators import windows
from sessionloom.streaming import live

SCHEMA = "id int, key string, ts timestamp"


def run(spark, tmp_path, pieces, gap=300, lateness=600):
    own = live.stateful_session(spark)
    for i, piece in enumerate(pieces):
        own.createDataFrame(piece, SCHEMA).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = own.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        live.start_idle_sessions(live.session_updates(stream, "key", "ts", gap, lateness), f"{tmp_path}/out", available_now=True).awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out/updates")


def expected(spark, rows):
    return sorted((tuple(r) for r in windows.idle_sessions(spark.createDataFrame(rows, SCHEMA), "key", "ts").drop("session_no").collect()), key=str)


@pytest.mark.parametrize("order", ["time", "shuffled"])
def test_updates_in_three_batches_equal_the_batch_operator(spark, tmp_path, order):
    rows = [(i, k, ts.replace(tzinfo=timezone.utc)) for i, k, ts in make_events(n=900)]
    rows.sort(key=lambda r: r[2])
    if order == "shuffled":
        random.Random(3).shuffle(rows)
    updates = run(spark, tmp_path, [rows[:300], rows[300:600], rows[600:]])
    found = sorted((tuple(r) for r in live.all_sessions(updates, "key").collect()), key=str)
    assert found == expected(spark, rows)
    late = live.late_intervals(updates, "key").count()
    assert late == 0 if order == "time" else late > 0


def test_late_event_joins_two_sessions_that_left_the_state(spark, tmp_path):
    at = lambda s: (START + timedelta(seconds=s)).replace(tzinfo=timezone.utc)
    first = [(1, "a", at(0)), (2, "a", at(500)), (3, "b", at(0)), (4, None, at(5)), (5, "a", None)]
    second = [(6, "a", at(10_000)), (7, "a", at(10_100))]
    third = [(8, "a", at(250)), (9, "a", at(9_900))]
    updates = run(spark, tmp_path, [first, second, third], lateness=60)
    got = sorted((tuple(r) for r in live.all_sessions(updates, "key").collect()), key=str)
    want = [("a", at(0), at(500), 3), ("a", at(9_900), at(10_100), 3), ("b", at(0), at(0), 1), (None, at(5), at(5), 1)]
    assert [(k, a.timestamp(), b.timestamp(), n) for k, a, b, n in got] == [(k, a.timestamp(), b.timestamp(), n) for k, a, b, n in sorted(want, key=str)]
    assert [(r.key, r.n_events, r.batch_id) for r in live.late_intervals(updates, "key").collect()] == [("a", 1, 2)]


def test_merge_intervals():
    rows = [(0, 10, 2, 5), (36, 40, 1, None), (19, 26, 1, 3), (100, 100, 1, None), (5, 6, 1, None)]
    assert live.merge_intervals(rows, 10) == [(0, 26, 4, [5, 3]), (36, 40, 1, []), (100, 100, 1, [])]
    assert live.merge_intervals(rows, 11) == [(0, 40, 5, [5, 3]), (100, 100, 1, [])]
    assert live.merge_intervals([], 10) == []
