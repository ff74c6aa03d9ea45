"""Ordered operators against brute force, with one key that owns most rows and gaps exactly at the limit."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from sessionloom.operators import windows
from sessionloom.streaming import sessions

START = datetime(2024, 1, 1)


def make_events(seed=5, n=3000):
    rng = random.Random(seed)
    clock = {k: 0 for k in "abc"}
    rows = []
    for i in range(n):
        key = rng.choices("abc", [8, 1, 1])[0]
        clock[key] += rng.choice([0, 1, 299_999_999, 300_000_000, 300_000_001, 5_000_000, 900_000_000])
        rows.append((i, key, START + timedelta(microseconds=clock[key])))
    return rows


def brute(rows, gap=timedelta(seconds=300)):
    last, number, out = {}, {}, {}
    for i, key, ts in rows:
        if key not in last or ts - last[key] >= gap:
            number[key] = number.get(key, 0) + 1
        last[key] = ts
        out[i] = number[key]
    return out


def test_idle_sessions(spark):
    rows = make_events()
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp_ntz").repartition(7)
    want = brute(rows)
    got = windows.assign_idle_sessions(df, "key", "ts").select("id", "session_no").collect()
    assert {r["id"]: r["session_no"] for r in got} == want
    stats = windows.idle_sessions(df, "key", "ts").collect()
    expected = {}
    for i, key, ts in rows:
        lo, hi, n = expected.get((key, want[i]), (ts, ts, 0))
        expected[(key, want[i])] = (min(lo, ts), max(hi, ts), n + 1)
    assert {(r["key"], r["session_no"]): (r["session_start"], r["session_end"], r["n_events"]) for r in stats} == expected


def test_carry_forward(spark):
    rng = random.Random(9)
    rows = [(f"f{rng.choices([0, 1, 2], [8, 1, 1])[0]}", i * 10, rng.random() < 0.02) for i in range(4000)]
    df = spark.createDataFrame(rows, "f string, at bigint, opens boolean").repartition(5)
    value = F.when(F.col("opens"), F.col("at"))
    got = windows.carry_forward(df, "f", "at", value, "ctx", segment_width=700).select("f", "at", "ctx").collect()
    last, want = {}, {}
    for f, at, opens in rows:
        if opens:
            last[f] = at
        want[(f, at)] = last.get(f)
    assert {(r["f"], r["at"]): r["ctx"] for r in got} == want


def test_session_stream_equals_batch(spark, tmp_path):
    rows = [(i, k, ts.replace(tzinfo=timezone.utc)) for i, k, ts in make_events(n=600)]
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp")
    df.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    # A last far event moves the watermark past every session.
    spark.createDataFrame([(-1, "z", datetime(2030, 1, 1, tzinfo=timezone.utc))], df.schema).write.parquet(str(tmp_path / "in2"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    query = (
        sessions.idle_session_stream(stream, "key", "ts").writeStream.format("memory").queryName("idle").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    live = {tuple(r) for r in spark.table("idle").collect()}
    batch = {tuple(r) for r in windows.idle_sessions(df, "key", "ts").drop("session_no").collect()}
    assert live == batch
