"""Keyed accumulation in micro-batches against the batch operators."""

import random

from pyspark.sql import functions as F

from sessionloom.operators import progress
from sessionloom.streaming import accumulate, live

VALUES = "project string, section string, value string, ts_ms bigint"


def deliver(spark, tmp_path, pieces, schema, make, mode):
    own = live.stateful_session(spark)
    added = []
    for i, piece in enumerate(pieces):
        own.createDataFrame(piece, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        accumulate.start_accumulation(make(own.readStream.schema(schema).parquet(f"{tmp_path}/in")), str(tmp_path), mode, available_now=True).awaitTermination()
        added.append(sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/rows").where(F.col("batch_id") == i).drop("batch_id").collect()), key=str))
    return added


def test_history_adds_a_value_once(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["p", "p", "p", "q", None]), rng.choice(["task", "next_action"]), rng.choice(["", "<no task>", " v1 \nmore", *[f"v{i}" for i in range(30)]]), t) for t in range(300)]
    pieces = [rows[:100], rows[50:200], rows[:300]]
    added = deliver(spark, tmp_path, pieces, VALUES, accumulate.history_stream, "append")
    stored = spark.createDataFrame([], "project string, section string, value string, first_seen_ms bigint")
    for piece, got in zip(pieces, added):
        fresh = progress.history(spark.createDataFrame(piece, VALUES)).where("project is not null")
        want = sorted((tuple(r) for r in fresh.join(stored, ["project", "section", "value"], "left_anti").collect()), key=str)
        assert [g for g in got if g[0] is not None] == want
        stored = spark.createDataFrame([*map(tuple, stored.collect()), *want], stored.schema)


def test_last_value_is_the_newest_non_empty_one(spark, tmp_path):
    pieces = [[("a", "x", 5), ("a", "", 9), ("b", "y", 1)], [("a", "old", 4), ("b", None, 7), ("c", "z", None)], [("a", "new", 6), ("b", "w", 1)]]
    added = deliver(spark, tmp_path, pieces, "k string, v string, n int", lambda s: accumulate.last_value_stream(s, "k", "v", "n"), "update")
    assert added == [[("a", "x", 5), ("b", "y", 1)], [], [("a", "new", 6)]]
