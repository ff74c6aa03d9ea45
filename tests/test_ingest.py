"""End-to-end ingest on hand-written transcripts: offsets, idempotence, chunked reads, streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import normalize
from sessionloom.plans import ingest
from sessionloom.sources import jsonl
from sessionloom.streaming import transcripts


def record(n, text, role="user", session="s1", **extra):
    body = {"uuid": f"u{n}", "parentUuid": f"u{n - 1}" if n else None, "sessionId": session, "type": "say",
            "timestamp": f"2026-01-01T00:00:{n:02d}Z", "message": {"role": role, "content": text}}
    return json.dumps({**body, **extra}, ensure_ascii=False)


def write(path, lines, tail=""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("".join(line + "\n" for line in lines) + tail)


LINES = [
    record(0, "Please repair the parser for nested lists"),
    record(1, [{"type": "text", "text": "Looking. Is it urgent?"}, {"type": "tool_use", "name": "w", "input": {"path": "src/a.rs"}}], "assistant"),
    "{broken",
    record(2, "Ünïcode ok — TODO: add tests"),
    json.dumps({"type": "summary", "sessionId": "s1", "uuid": "z"}),
    record(3, "All done. Run the tests.", "assistant"),
]


def snapshot(wh):
    led = [tuple(r) for r in wh.ledger().orderBy("source_path", "end_offset").collect()]
    dig = [tuple(r) for r in wh.digests().orderBy("session_id").collect()]
    log = sorted(r["entry"] for r in wh.progress_log().collect())
    hist = sorted((r["project"], r["section"], r["value"]) for r in wh.history().collect())
    return led, dig, log, hist


def test_ingest_twice_equals_once(spark, tmp_path):
    src = tmp_path / "t" / "-work-demo" / "a.jsonl"
    write(str(src), LINES)
    wh = ingest.open_warehouse(spark, str(tmp_path / "wh"))
    ingest.ingest_path(wh, "claude", str(tmp_path / "t"), 0)
    once = snapshot(wh)
    assert len(once[0]) == 4
    assert [r["reason"] for r in wh.rejects().collect()] == ["corrupt json"]
    offset = wh.offset_log().collect()[0]
    assert offset["byte_offset"] == os.path.getsize(src) and offset["last_uuid"] == "u3"
    ingest.ingest_path(wh, "claude", str(tmp_path / "t"), 1)
    assert snapshot(wh) == once
    ingest.ingest_path(wh, "claude", str(tmp_path / "t"), 2, full_refresh=True)
    assert snapshot(wh) == once
    d = wh.digests().collect()[0]
    assert d["task"] == "Please repair the parser for nested lists"
    assert d["next_action"] == "All done. Run the tests."
    assert d["open_questions"] == ["Is it urgent?", "add tests"]
    assert d["recent_files"] == ["src/a.rs"]
    assert {r["project"] for r in wh.history().collect()} == {"/work/demo"}


def test_growing_file_equals_one_read(spark, tmp_path):
    src = tmp_path / "t" / "-work-demo" / "a.jsonl"
    wh = ingest.open_warehouse(spark, str(tmp_path / "wh"))
    write(str(src), LINES[:2], tail=LINES[2][:3])
    ingest.ingest_path(wh, "claude", str(tmp_path / "t"), 0)
    assert wh.ledger().count() == 2
    write(str(src), LINES)
    ingest.ingest_path(wh, "claude", str(tmp_path / "t"), 1)
    whole = ingest.open_warehouse(spark, str(tmp_path / "wh2"))
    ingest.ingest_path(whole, "claude", str(tmp_path / "t"), 0)
    grown, once = snapshot(wh), snapshot(whole)
    assert grown[0] == once[0] and grown[1] == once[1] and grown[2] == once[2]
    ingest.rebuild_digests(wh, 2)
    assert snapshot(wh)[1] == once[1]


def test_retry_after_lost_offsets(spark, tmp_path, monkeypatch):
    src = tmp_path / "t" / "-work-demo" / "a.jsonl"
    write(str(src), LINES)
    wh = ingest.open_warehouse(spark, str(tmp_path / "wh"))
    with monkeypatch.context() as m:
        m.setattr(type(wh), "append_offsets", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            ingest.ingest_path(wh, "claude", str(tmp_path / "t"), 0)
    ingest.ingest_path(wh, "claude", str(tmp_path / "t"), 0)
    assert wh.ledger().count() == 4 and wh.digests().count() == 1
    assert wh.offset_log().count() == 1


def codex_lines():
    meta = lambda sid, cwd: json.dumps({"type": "session_meta", "payload": {"id": sid, "cwd": cwd}})
    event = lambda i, who, text: json.dumps({"type": "event_msg", "timestamp": f"2026-02-01T00:00:{i:02d}.500Z", "payload": {"type": who, "message": text}})
    return [
        meta("c1", "/work/p1"), event(1, "user_message", "Write the importer please"), event(2, "agent_message", "Done. Next?"),
        meta("c2", "/work/p2"), event(3, "user_message", "Now the exporter, thank you"), event(4, "agent_message", ""),
        event(5, "token_count", "x"), event(6, "agent_message", "Exported."),
    ]


def test_codex_session_carries_over_chunks(spark, tmp_path):
    src = tmp_path / "s" / "2026" / "02" / "01" / "rollout-1.jsonl"
    lines = codex_lines()
    wh = ingest.open_warehouse(spark, str(tmp_path / "wh"))
    write(str(src), lines[:5])
    ingest.ingest_path(wh, "codex", str(tmp_path / "s"), 0)
    write(str(src), lines)
    ingest.ingest_path(wh, "codex", str(tmp_path / "s"), 1)
    got = [(r["session_id"], r["role"], r["content"], r["ts_ms"] % 100000) for r in wh.ledger().orderBy("end_offset").collect()]
    assert got == [
        ("c1", "user", "Write the importer please", 1500), ("c1", "assistant", "Done. Next?", 2500),
        ("c2", "user", "Now the exporter, thank you", 3500), ("c2", "assistant", "Exported.", 6500),
    ]
    assert {r["project"] for r in wh.history().collect()} == {"/work/p1"}


def test_strict_mode(spark, tmp_path):
    write(str(tmp_path / "t" / "-w" / "a.jsonl"), [LINES[2]])
    wh = ingest.open_warehouse(spark, str(tmp_path / "wh"))
    with pytest.raises(Exception, match="corrupt json at byte"):
        ingest.ingest_path(wh, "claude", str(tmp_path / "t"), 0, mode="FAILFAST")
    write(str(tmp_path / "s" / "r.jsonl"), codex_lines()[:1], tail='{"type":"secret')
    with pytest.raises(Exception, match="partial line at byte") as failure:
        ingest.ingest_path(wh, "codex", str(tmp_path / "s"), 0, mode="FAILFAST")
    assert "secret" not in str(failure.value)


def test_stream_equals_batch(spark, tmp_path):
    for i, line in enumerate(LINES):
        write(str(tmp_path / "t" / "-work-demo" / f"{i}.jsonl"), [line])
    stream_wh = ingest.open_warehouse(spark, str(tmp_path / "wh1"))
    lines = transcripts.transcript_stream(spark, str(tmp_path / "t")) 
    query = transcripts.start_ingest(stream_wh, lines, "claude", str(tmp_path / "cp"), available_now=True)
    query.awaitTermination(120)
    assert query.exception() is None
    batch_wh = ingest.open_warehouse(spark, str(tmp_path / "wh2"))
    ingest.ingest_path(batch_wh, "claude", str(tmp_path / "t"), 0)
    assert snapshot(stream_wh) == snapshot(batch_wh)
    again = transcripts.start_ingest(stream_wh, transcripts.transcript_stream(spark, str(tmp_path / "t")), "claude", str(tmp_path / "cp"), available_now=True)
    again.awaitTermination(120)
    assert snapshot(stream_wh) == snapshot(batch_wh)


def test_signals_drive_ingest(spark, tmp_path):
    """A hook names one tool; a rescan reads both; nothing is stored twice."""
    write(str(tmp_path / "t" / "-work-demo" / "a.jsonl"), LINES)
    write(str(tmp_path / "s" / "rollout-1.jsonl"), codex_lines())
    roots = {"claude": str(tmp_path / "t"), "codex": str(tmp_path / "s")}
    schema = "tool string, path string, session_id string, ts timestamp, rescan boolean"
    wh = ingest.open_warehouse(spark, str(tmp_path / "wh"))

    def signal(name, tool, rescan):
        spark.createDataFrame([(tool, "x", "default", rescan)], "tool string, path string, session_id string, rescan boolean").withColumn(
            "ts", F.current_timestamp()
        ).write.json(str(tmp_path / "signals" / name))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "signals" / "*"))
        query = transcripts.ingest_on_signals(wh, stream, roots, str(tmp_path / "cp"), available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None

    signal("1", "claude", False)
    assert {r["tool"] for r in wh.ledger().collect()} == {"claude"}
    signal("2", "claude", True)
    assert wh.ledger().groupBy("tool").count().collect().__len__() == 2 and wh.ledger().count() == 8
    wh.write_documents(str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).filter("value like '# Last updated%'").count() == 3
    wh.write_audit_log(str(tmp_path / "audit"))
    assert "corrupt json at byte" in spark.read.json(str(tmp_path / "audit")).first()["message"]


def test_two_streams_share_a_session_and_a_batch_id(spark, tmp_path):
    """Batch ids are counted per tool: the newest turn decides, and a batch digests its own tool's turns only."""
    wh = ingest.open_warehouse(spark, str(tmp_path / "wh"))
    columns = "tool string, source_path string, end_offset bigint, session_id string, ts_ms bigint, role string, content string, status string"

    def store(tool, batch_id, rows):
        df = spark.createDataFrame([(tool, *r, "ok") for r in rows], columns)
        ingest.store_batch(wh, normalize.finish(df), tool, batch_id)
        ingest.digest_batch(wh, tool, batch_id)

    store("codex", 5, [("a.jsonl", 10, "s", 1000, "user", "write the first program"), ("a.jsonl", 20, "s", 2000, "assistant", "Old answer")])
    store("claude", 0, [("b.jsonl", 10, "s", 9000, "assistant", "New answer")])
    assert [r["next_action"] for r in wh.digests().collect()] == ["New answer"]
    store("cursor", 5, [("c.jsonl", 10, "other", 3000, "user", "another session here")])
    log = wh.digest_log().groupBy("session_id").count().collect()
    assert {r["session_id"]: r["count"] for r in log} == {"s": 2, "other": 1}


def test_files_that_did_not_grow_are_not_opened(spark, tmp_path):
    wh = ingest.open_warehouse(spark, str(tmp_path / "wh"))
    source = tmp_path / "in"
    write(str(source / "p [1]" / "a.jsonl"), LINES[:2])
    write(str(source / "p" / "b.jsonl"), [record(0, "A second file of another session", session="s2")])
    ingest.ingest_path(wh, "claude", str(source), 0)
    before = wh.ledger().count()
    offsets = wh.offset_log()
    assert before == 3 and jsonl.grown_sources(spark, str(source), offsets) == []
    ingest.ingest_path(wh, "claude", str(source), 1)
    assert wh.ledger().count() == before
    with open(source / "p [1]" / "a.jsonl", "a", encoding="utf-8") as f:
        f.write(record(7, "One more prompt for the first file") + "\n")
    grown = jsonl.grown_sources(spark, str(source), offsets)
    assert len(grown) == 1 and grown[0].endswith("a.jsonl")
    ingest.ingest_path(wh, "claude", str(source), 2)
    assert wh.ledger().count() == before + 1


def test_retention_removes_old_sessions_for_good(spark, tmp_path):
    wh = ingest.open_warehouse(spark, str(tmp_path / "wh"))
    old = [record(i, f"An old prompt number {i}", session="old") for i in range(3)]
    new = [record(i, f"A newer prompt number {i}", session="new") for i in range(20, 23)]
    write(str(tmp_path / "t" / "-work-demo" / "a.jsonl"), old)
    ingest.ingest_path(wh, "claude", str(tmp_path / "t"), 0)
    write(str(tmp_path / "t" / "-work-demo" / "b.jsonl"), new)
    ingest.ingest_path(wh, "claude", str(tmp_path / "t"), 1)
    border = wh.ledger().filter("session_id = 'new'").agg(F.min("ts_ms")).first()[0]
    for _ in range(2):
        ingest.trim(wh, border)
        assert {r["session_id"] for r in wh.ledger().collect()} == {"new"} and wh.ledger().count() == 3
        assert [r["session_id"] for r in wh.digests().collect()] == ["new"]
        assert {r["session_id"] for r in wh.session_state().collect()} == {"new"}
    ingest.ingest_path(wh, "claude", str(tmp_path / "t"), 2)
    ingest.ingest_path(wh, "claude", str(tmp_path / "t"), 3, full_refresh=True)
    assert wh.ledger().count() == 3
    write(str(tmp_path / "t" / "-work-demo" / "a.jsonl"), [*old, record(40, "The old session goes on", session="old")])
    ingest.ingest_path(wh, "claude", str(tmp_path / "t"), 4)
    assert sorted(r["content"] for r in wh.ledger().filter("session_id = 'old'").collect()) == ["The old session goes on"]
