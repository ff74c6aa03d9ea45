import json
import os
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import incremental, normalize
from sessionloom.plans import ingest
from sessionloom.sources import jsonl, tail


def put(path, data, mode="wb"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


def rows(df):
    return sorted((unquote(os.path.basename(r.source_path)), r.start_offset, r.end_offset, r.line) for r in df.select("source_path", "start_offset", "end_offset", "line").collect())


def expected(files, begin=None):
    out = []
    for name, data in files.items():
        at = 0
        for line in data.split(b"\n")[:-1]:
            if at + len(line) + 1 > (begin or {}).get(name, 0):
                out.append((name, at, at + len(line) + 1, line.decode()))
            at += len(line) + 1
    return sorted(out)


FILES = {
    "a.jsonl": "".join(f'{{"n": {i}, "t": "{"x" * (i % 37)}"}}\n' for i in range(400)).encode(),
    "b c.jsonl": "ä€😀\n\r\n\n".encode() + b"y" * 9000 + b"\nopen end",
    "empty.jsonl": b"",
    "open.jsonl": b"never ended",
    "blank.jsonl": b"\n\n\n",
}


@pytest.mark.parametrize("split", [1, 64, 1 << 20])
def test_lines_of_ranges_of_any_length(spark, tmp_path, split):
    files = {k: v[: 60 if split == 1 else None] for k, v in FILES.items()}
    for name, data in files.items():
        put(f"{tmp_path}/{name}", data)
    assert rows(tail.read_new(spark, "claude", str(tmp_path), split_bytes=split)) == expected(files)


def test_equals_the_scan(spark, tmp_path):
    for name, data in FILES.items():
        put(f"{tmp_path}/{name}", data)
    kept = ["tool", "source_path", "start_offset", "end_offset", "line", "is_complete"]
    found, scanned = (sorted(map(tuple, df.select(*kept).collect())) for df in (tail.read_new(spark, "claude", str(tmp_path)), jsonl.scan_path(spark, "claude", str(tmp_path))))
    assert found == scanned


def test_only_new_bytes_are_read(spark, tmp_path):
    path = f"{tmp_path}/a.jsonl"
    old = b"".join(b'{"n": %d}\n' % i for i in range(20_000))
    put(path, old)
    raw = tail.read_new(spark, "claude", str(tmp_path))
    offsets = raw.groupBy("source_path").agg(F.max("end_offset").alias("byte_offset")).collect()
    offsets = spark.createDataFrame(offsets)
    counter = spark.sparkContext.accumulator(0)
    assert tail.read_new(spark, "claude", str(tmp_path), offsets, counter=counter).count() == 0 and counter.value == 0
    put(path, b'{"new": 1}\n{"half', "ab")
    assert rows(tail.read_new(spark, "claude", str(tmp_path), offsets, counter=counter)) == [("a.jsonl", len(old), len(old) + 11, '{"new": 1}')]
    assert counter.value == 17 + 1  # what was added, and the byte before it


def test_strict_read_names_the_place_of_a_partial_line(spark, tmp_path):
    put(f"{tmp_path}/a.jsonl", b"one\ntwo\nthr")
    with pytest.raises(Exception, match="partial line at byte 8"):
        tail.read_new(spark, "codex", str(tmp_path), strict=True).collect()
    with pytest.raises(Exception, match="partial line at byte 8"):
        tail.read_new(spark, "codex", str(tmp_path), strict=True, split_bytes=10).collect()
    put(f"{tmp_path}/a.jsonl", b"ee\n", "ab")
    assert tail.read_new(spark, "codex", str(tmp_path), strict=True).count() == 3


@pytest.mark.parametrize("split", [50, 1 << 20])
def test_context_goes_over_ranges_and_reads(spark, tmp_path, split):
    meta = lambda s: json.dumps({"type": "session_meta", "payload": {"id": s, "cwd": "/w"}})
    lines = ["before", meta("s1"), *["x" * 30] * 5, meta("s2"), "y", *["z" * 60] * 3]
    put(f"{tmp_path}/a.jsonl", "".join(f"{x}\n" for x in lines).encode())
    put(f"{tmp_path}/b.jsonl", f"q\n{meta('s9')}\nr\n".encode())
    read = lambda known: tail.read_new(spark, "codex", str(tmp_path), known, opened=normalize.opened_session(F.col("line")), split_bytes=split)
    got = {(os.path.basename(r.source_path), r.start_offset): r.context_session_id for r in read(None).collect()}
    want, at = {}, 0
    for i, x in enumerate(lines):
        want["a.jsonl", at] = None if i == 0 else "s1" if i < 7 else "s2"
        at += len(x) + 1
    want |= {("b.jsonl", 0): None, ("b.jsonl", 2): "s9", ("b.jsonl", 3 + len(meta("s9"))): "s9"}
    assert got == want
    known = read(None).groupBy("source_path").agg(F.max("end_offset").alias("byte_offset"), F.max_by("context_session_id", "end_offset").alias("last_session_id"))
    known = spark.createDataFrame(known.collect(), known.schema)
    put(f"{tmp_path}/a.jsonl", b"later\n" * 20, "ab")
    assert {r.context_session_id for r in read(known).collect()} == {"s2"}


def stream(spark, folder, state, split=1 << 20):
    out = []

    def keep(batch, batch_id):
        out.extend((batch_id, *r) for r in rows(tail.as_raw(batch, "claude")))

    job = tail.tail_stream(spark, folder, split_bytes=split).writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    job.awaitTermination()
    return out


def test_stream_reads_what_was_appended_once(spark, tmp_path):
    folder, state = f"{tmp_path}/in put", f"{tmp_path}/state"
    put(f"{folder}/p/a.jsonl", b"one\ntwo\nthr")
    put(f"{folder}/skip.txt", b"no\n")
    first = stream(spark, folder, state)
    assert [x[1:] for x in first] == [("a.jsonl", 0, 4, "one"), ("a.jsonl", 4, 8, "two")]
    put(f"{folder}/p/a.jsonl", b"ee\nfour\n", "ab")
    put(f"{folder}/q/b.jsonl", b"new\n")
    with open(f"{folder}/p/a.jsonl", "r+b") as f:  # bytes that were read are not read again
        f.write(b"XXX\n")
    second = stream(spark, folder, state, split=3)
    assert [x[1:] for x in second] == [("a.jsonl", 8, 14, "three"), ("a.jsonl", 14, 19, "four"), ("b.jsonl", 0, 4, "new")]
    assert {x[0] for x in first} == {0} and {x[0] for x in second} == {1}
    assert stream(spark, folder, state) == []


def codex_lines(n, at=0):
    meta = [json.dumps({"type": "session_meta", "payload": {"id": "s", "cwd": "/home/u/proj"}})] if not at else []
    turn = lambda i: json.dumps({"timestamp": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z", "type": "event_msg", "payload": {"type": "user_message", "message": f"m{i}"}})
    return "".join(f"{x}\n" for x in [*meta, *(turn(i) for i in range(at, n))]).encode()


def test_ingest_of_a_growing_rollout(spark, tmp_path):
    path = f"{tmp_path}/in/2024/01/01/rollout.jsonl"
    whole = codex_lines(40)
    warehouse = ingest.open_warehouse(spark, f"{tmp_path}/wh")
    cuts = [0, 700, 701, 2500, len(whole)]
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:])):
        put(path, whole[a:b], "ab")
        ingest.ingest_path(warehouse, "codex", f"{tmp_path}/in", batch)
    ledger = warehouse.ledger().collect()
    assert sorted(r.content for r in ledger) == sorted(f"m{i}" for i in range(40)) and {r.session_id for r in ledger} == {"s"}
    state = incremental.current_offsets(warehouse.offset_log()).collect()
    assert [(r.byte_offset, r.last_session_id, r.project_dir) for r in state] == [(len(whole), "s", "/home/u/proj")]


def test_stream_ingest_of_a_growing_rollout(spark, tmp_path):
    from sessionloom.streaming import transcripts

    path = f"{tmp_path}/in/rollout.jsonl"
    whole = codex_lines(30)
    warehouse = ingest.open_warehouse(spark, f"{tmp_path}/wh")
    for a, b in ((0, 1000), (1000, 1001), (1001, len(whole))):
        put(path, whole[a:b], "ab")
        job = transcripts.start_tail_ingest(warehouse, "codex", f"{tmp_path}/in", f"{tmp_path}/state", available_now=True)
        job.awaitTermination()
    ledger = warehouse.ledger().collect()
    assert sorted(r.content for r in ledger) == sorted(f"m{i}" for i in range(30)) and {r.session_id for r in ledger} == {"s"}


def test_a_range_is_read_in_bounded_memory(tmp_path):
    """What a task holds does not grow with its range: some copies of a chunk of a megabyte."""
    import tracemalloc

    path = tmp_path / "long.jsonl"
    line = b'{"text":"' + b"x" * 600 + b'"}\n'
    n = 40_000
    path.write_bytes(line * n)
    with tail._File(path.as_uri()) as file:
        assert sum(b.num_rows for b in tail._lines(file, "long", 0, len(line), False)) == 1  # what is imported at first use
        tracemalloc.start()
        try:
            read = sum(b.num_rows for b in tail._lines(file, "long", 0, n * len(line), True))
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
    assert read == n
    assert peak < 8 << 20
