"""Merged sketches against exact figures."""

import random

from pyspark.sql import functions as F

from sessionloom.operators import metrics


def test_merged_batches_equal_one_pass_and_estimates_are_close(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["claude", "codex", None]), f"s{rng.randrange(4000)}", 1_700_000_000_000 + rng.randrange(90) * 86_400_000, rng.choice([None, "x" * rng.randrange(500)])) for _ in range(20_000)]
    led = spark.createDataFrame(rows, "tool string, session_id string, ts_ms bigint, content string")
    for i in range(3):
        metrics.batch_metrics(led.where(F.abs(F.hash("session_id", "ts_ms")) % 3 == i)).write.parquet(f"{tmp_path}/b={i}")
    merged, once = metrics.metrics(spark.read.parquet(str(tmp_path))), metrics.metrics(metrics.batch_metrics(led))
    exact = ["tool", "week", "month", "level", "n_turns", "n_chars", "first_ms", "last_ms"]
    assert sorted(map(str, merged.select(*exact).collect())) == sorted(map(str, once.select(*exact).collect()))
    week, month = (F.date_trunc(p, F.to_timestamp(F.timestamp_millis("ts_ms"))).cast("date").alias(p) for p in ("week", "month"))
    true = led.select("tool", week, month, "session_id", F.coalesce(F.length("content"), F.lit(0)).alias("n"))
    true = true.cube("tool", "week", "month").agg(F.grouping_id().alias("level"), F.countDistinct("session_id").alias("sessions"), F.array_sort(F.collect_list("n")).alias("n"))
    want = {(r.tool, r.week, r.month, r.level): r for r in true.collect()}
    for r in merged.collect():
        t = want.pop((r.tool, r.week, r.month, r.level))
        assert abs(r.n_sessions - t.sessions) <= max(2, 0.04 * t.sessions)  # five deviations
        for q, value in ((0.5, r.length_p50), (0.95, r.length_p95)):
            below, upto = sum(x < value for x in t.n), sum(x <= value for x in t.n)
            assert below - 0.04 * len(t.n) - 1 <= q * len(t.n) <= upto + 0.04 * len(t.n) + 1
    assert not want
    assert metrics.metrics(metrics.batch_metrics(led.limit(0))).where("n_turns > 0").count() == 0
