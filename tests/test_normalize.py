"""Record mapping, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import hooks, incremental, normalize, reads
from sessionloom.sources import hooks as hook_source
from sessionloom.sources import memory
from sessionloom.streaming import signals


def raw(spark, lines, tool="claude", path="f"):
    return memory.records(spark, tool, path, [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines])


def base(**over):
    record = {"uuid": "u", "parentUuid": None, "sessionId": "s", "type": "say", "role": "user", "content": "hi", "ts": 5}
    record.update(over)
    return {k: v for k, v in record.items() if v != "DROP"}


USE = {"type": "tool_use", "name": "w", "input": {"path": "b.rs"}}


@pytest.mark.parametrize(
    "record, want",
    [
        (base(), ("ok", None, "user", "hi", 5, None, None)),
        (base(message={"role": "assistant", "content": "in"}), ("ok", None, "assistant", "in", 5, None, None)),
        (base(message={"role": None}), ("ok", None, "say", "hi", 5, None, None)),
        (base(message="text"), ("ok", None, "user", "hi", 5, None, None)),
        (base(role=7), ("ok", None, "say", "hi", 5, None, None)),
        (base(role=7, type="DROP"), ("rejected", "missing role", None, None, None, None, None)),
        (base(content=None), ("ok", None, "user", "null", 5, None, None)),
        (base(content="DROP"), ("ok", None, "user", "", 5, None, None)),
        (base(content={"b": 1, "a": [True, "é\n"]}), ("ok", None, "user", '{"a":[true,"é\\n"],"b":1}', 5, None, None)),
        (base(content=[USE, {"type": "text", "text": "x"}, {"type": "tool_use", "input": {"path": 3}}]),
         ("ok", None, "user", '[{"input":{"path":"b.rs"},"name":"w","type":"tool_use"},{"text":"x","type":"text"},{"input":{"path":3},"type":"tool_use"}]', 5,
          '[{"input":{"path":"b.rs"},"name":"w","type":"tool_use"},{"input":{"path":3},"type":"tool_use"}]', '["b.rs"]')),
        (base(sessionId="DROP"), ("rejected", "missing sessionId", None, None, None, None, None)),
        (base(sessionId=4), ("rejected", "missing sessionId", None, None, None, None, None)),
        (base(ts="DROP"), ("skipped", None, None, None, None, None, None)),
        (base(timestamp="2026-01-01T00:00:00Z"), ("ok", None, "user", "hi", 1767225600000, None, None)),
        (base(timestamp=None), ("rejected", "bad timestamp", None, None, None, None, None)),
        (base(ts=1.5), ("rejected", "bad timestamp", None, None, None, None, None)),
        (base(type="summary", sessionId="DROP"), ("skipped", None, None, None, None, None, None)),
        (base(type="DROP"), ("ok", None, "user", "hi", 5, None, None)),
        ('{"sessionId":', ("rejected", "corrupt json", None, None, None, None, None)),
    ],
)
def test_claude(spark, record, want):
    r = normalize.normalize_claude(raw(spark, [record])).first()
    assert (r["status"], r["reason"], r["role"], r["content"], r["ts_ms"], r["tool_calls_json"], r["files_touched_json"]) == want


def test_parent_chain(spark):
    lines = [base(uuid=f"u{i}", parentUuid=f"u{i - 1}" if i else None, ts=i) for i in range(5)]
    rows = normalize.turns(normalize.normalize_claude(raw(spark, lines)))
    orphans = rows.filter("parent_id is not null").join(rows.select(F.col("record_uuid").alias("parent_id")), "parent_id", "left_anti")
    assert orphans.count() == 0 and rows.filter("parent_id is null").count() == 1


def test_codex(spark):
    old = {"type": "event_msg", "session_id": "own", "seq": 3, "role": "tool", "content": ["x"], "ts": "9",
           "tool_calls": [{"input": {"path": "p"}}, {"input": {"cmd": "ls"}}]}
    lines = [
        {"type": "event_msg", "timestamp": "2026-01-01T00:00:00Z", "payload": {"type": "user_message", "message": "early"}},
        {"type": "session_meta", "session_id": "m1", "cwd": "/w1"},
        {"type": "event_msg", "ts": 4, "payload": {"type": "agent_message", "message": "new"}},
        old,
        {**old, "ts": "soon"},
        {**old, "role": None},
        {**old, "session_id": "", "tool_calls": []},
        {"type": "other", "seq": 99},
        {"type": "session_meta", "payload": {"id": "m2"}},
        {"type": "event_msg", "seq": 8, "ts": 6, "payload": {"type": "user_message", "message": "after"}},
    ]
    n = normalize.normalize_codex(raw(spark, lines, "codex"))
    got = [tuple(r) for r in normalize.turns(n).orderBy("end_offset").select("session_id", "role", "content", "ts_ms", "tool_calls_json", "files_touched_json").collect()]
    calls = '[{"input":{"path":"p"}},{"input":{"cmd":"ls"}}]'
    assert got == [
        ("m1", "assistant", "new", 4, None, None), ("own", "tool", '["x"]', 9, calls, '["p"]'), ("m1", "tool", '["x"]', 9, None, None),
        ("m2", "user", "after", 6, None, None),
    ]
    state = incremental.advance_offsets(n).first()
    assert (state["last_event_seq"], state["last_session_id"]) == (8, "m2")
    seed = spark.createDataFrame([("codex", "f", 1, "prior")], "tool string, source_path string, byte_offset bigint, last_session_id string")
    seeded = normalize.turns(normalize.normalize_codex(raw(spark, lines, "codex"), seed)).orderBy("end_offset").first()
    assert (seeded["session_id"], seeded["content"]) == ("prior", "early")


def test_history_and_duplicates(spark):
    lines = [{"session_id": "s", "ts": 5, "text": "go"}, {"session_id": "", "ts": 5, "text": "go"}, {"session_id": "s", "text": ""}, {"session_id": "s", "ts": "x", "text": "t"}]
    rows = normalize.turns(normalize.normalize_codex_history(raw(spark, lines, "codex")))
    assert sorted((r["ts_ms"], r["content"]) for r in rows.collect()) == [(0, "t"), (5000, "go")]
    assert normalize.drop_history_duplicates(rows.unionByName(rows)).count() == 2


def test_offsets_never_regress(spark):
    schema = "tool string, source_path string, byte_offset bigint, last_event_seq bigint, last_uuid string, last_session_id string, project_dir string"
    old = spark.createDataFrame([("t", "a", 50, 4, "u", None, "/p"), ("t", "b", 10, 0, None, None, None)], schema)
    new = spark.createDataFrame([("t", "a", 40, 9, None, "s", None), ("t", "b", 20, 0, "v", None, None)], schema)
    got = {r["source_path"]: tuple(r)[2:] for r in incremental.merge_offsets(old, new).collect()}
    assert got == {"a": (50, 9, "u", "s", "/p"), "b": (20, 0, "v", None, None)}


def test_status_and_sources(spark):
    led = spark.createDataFrame([("s", "claude", 1000 + i * 10, "user", "x" * 80) for i in range(5)], "session_id string, tool string, ts_ms bigint, role string, content string")
    assert [r["ts_ms"] for r in reads.query_recent(led, "claude", 3).collect()] == [1040, 1030, 1020]
    assert [r["ts_ms"] for r in reads.query_session(led, "s").collect()] == [1000, 1010, 1020, 1030, 1040]
    enabled = spark.createDataFrame([("claude",), ("codex",)], "tool string")
    rows = {(r["tool"], r["rank"]): r["preview"] for r in reads.status(led, enabled).collect()}
    assert rows == {("claude", 1): "x" * 60, ("claude", 2): "x" * 60, ("claude", 3): "x" * 60, ("codex", None): None}


def test_hook_bodies(spark):
    bodies = [
        ("claude", json.dumps({"transcript_path": "/t/a.jsonl", "session_id": "s", "cwd": "/w", "extra1": {"a": 1}, "n": 5})),
        ("vim", "{}"), ("codex", json.dumps({"transcript_path": "/t/../x"})), ("cursor", json.dumps({"cwd": "rel"})),
        ("cursor", json.dumps({"pad": "x" * 70000})),
    ]
    df = spark.createDataFrame([(t, "stop", b) for t, b in bodies], "tool string, event string, body string").withColumn("ts", F.current_timestamp())
    rows = hooks.validate(hook_source.from_bodies(df), 65536).collect()
    assert [r["reject_reason"] for r in rows] == [None, "unknown tool", "transcript_path has parent component", None, "body too large"]
    assert rows[0]["extra"] == {"extra1": '{"a":1}', "n": "5"} and rows[0]["cwd"] == "/w" and rows[3]["cwd"] is None


def test_signal_streams(spark, tmp_path):
    """Two notification streams, merged and coalesced, equal the batch result."""
    hook = [("claude", "stop", f"/t/{i % 3}.jsonl", None, None, None, 1_700_000_000_000 + i * 90) for i in range(20)]
    to_ts = F.timestamp_millis("ms").alias("ts")
    hook_df = spark.createDataFrame(hook, "tool string, event string, transcript_path string, session_id string, cwd string, extra map<string,string>, ms bigint").select("*", to_ts).drop("ms")
    watch = [("codex", "/t/9.jsonl" if i % 4 else "", "modify" if i % 3 else "access", False, 1_700_000_000_000 + i * 70) for i in range(20)]
    watch_df = spark.createDataFrame(watch, "tool string, path string, kind string, rescan boolean, ms bigint").select("*", to_ts).drop("ms")
    hook_df.write.json(str(tmp_path / "hooks"))
    watch_df.write.json(str(tmp_path / "watch"))
    end = watch_df.limit(1).select("tool", F.lit("/end").alias("path"), F.lit("create").alias("kind"), "rescan", F.timestamp_millis(F.lit(1_800_000_000_000)).alias("ts"))
    end.write.mode("append").json(str(tmp_path / "watch"))
    h_end = hook_df.limit(1).withColumn("transcript_path", F.lit("/end")).withColumn("ts", F.timestamp_millis(F.lit(1_800_000_000_000)))
    h_end.write.mode("append").json(str(tmp_path / "hooks"))
    merged = signals.signals(
        signals.hook_stream(spark, str(tmp_path / "hooks")), spark.readStream.schema(watch_df.schema).json(str(tmp_path / "watch"))
    )
    query = (
        signals.coalesced(merged).writeStream.format("memory").queryName("signals").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    live = {tuple(r) for r in spark.table("signals").collect()}
    batch = {tuple(r) for r in hooks.coalesce_bursts(signals.signals(hook_df, watch_df)).collect()}
    assert live == batch and any(r[4] for r in batch)


def test_active_source_and_projects(spark):
    files = spark.createDataFrame([("/s/1", 1, "/a"), ("/s/2", 2, "/a"), ("/s/3", 3, None)], "path string, mtime int, cwd string")
    projects = spark.createDataFrame([("/a",), ("/b",)], "project string")
    assert {tuple(r) for r in reads.active_source(projects, files).collect()} == {("/a", "/s/2"), ("/b", "/s/3")}
    r = spark.range(1).select(
        hooks.resolve_project(F.lit("/home"), F.lit("/w"), F.lit("/x/-p-q/f"), F.lit("/home")).alias("a"),
        hooks.resolve_project(F.lit(None), F.lit(None), F.lit("/x/-p-q/f"), F.lit("/home")).alias("b"),
        hooks.slug(F.lit("/p/q")).alias("c"),
        hooks.has_parent_component(F.lit("/a/..b/c")).alias("d"),
    ).first()
    assert tuple(r) == ("/w", "/p/q", "-p-q", False)
