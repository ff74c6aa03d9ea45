"""Byte offsets against brute force, with files cut into many splits."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.sources import jsonl


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def make_files(folder, seed=3):
    rng = random.Random(seed)
    want = {}
    for i in range(6):
        # One file holds most of the bytes.
        count = 4000 if i == 0 else rng.randrange(0, 60)
        lines = []
        for n in range(count):
            text = rng.choice(["", "x", "日本", "a\r", "é" * rng.randrange(200), "w " * rng.randrange(60)])
            lines.append(f"{n}:{text}")
        tail = rng.choice(["", "partial é"]) if i else "cut off"
        path = os.path.join(folder, f"p{i % 2}", f"{i}.jsonl")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write("".join(x + "\n" for x in lines).encode() + tail.encode())
        end = 0
        for x in lines:
            start, end = end, end + len(x.encode()) + 1
            want[(f"{i}.jsonl", end)] = (start, x)
    return want


def found(raw):
    name = F.substring_index("source_path", "/", -1)
    return {(r[0], r[1]): (r[2], r[3]) for r in raw.select(name, "end_offset", "start_offset", "line").collect()}


def test_offsets(spark, tmp_path, small_splits):
    want = make_files(str(tmp_path))
    lines = jsonl.read_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    assert found(jsonl.scan_jsonl(lines, "claude")) == want
    one = jsonl.scan_jsonl(lines, "claude").filter("source_path like '%/0.jsonl'")
    assert found(one) == {k: v for k, v in want.items() if k[0] == "0.jsonl"}


def test_offsets_without_broadcast(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(jsonl, "MAX_BROADCAST_SPLITS", 0)
    want = make_files(str(tmp_path), seed=4)
    assert found(jsonl.scan_path(spark, "claude", str(tmp_path))) == want


def test_listing(spark, tmp_path):
    make_files(str(tmp_path))
    (tmp_path / "p0" / "note.txt").write_text("no")
    rows = jsonl.list_sources(spark, str(tmp_path)).collect()
    assert {(r["project"], r["source_path"].rsplit("/", 1)[1]) for r in rows} == {(f"p{i % 2}", f"{i}.jsonl") for i in range(6)}
    assert all(r["size"] == os.path.getsize(r["source_path"].removeprefix("file:")) for r in rows)


def test_context_crosses_splits_and_batches(spark, tmp_path, small_splits):
    """The open session of every record, in one large file, against brute force; the Arrow batches are made tiny too."""
    rng = random.Random(11)
    lines, want, open_now = [], [], None
    for n in range(3000):
        if rng.random() < 0.003:
            lines.append(f'{{"type":"session_meta","payload":{{"id":"c{n}"}}}}')
            open_now = f"c{n}"
        elif rng.random() < 0.01:
            lines.append('{"type":"event_msg","text":"session_meta é"}')
        elif rng.random() < 0.01:
            lines.append('{"type":"session_meta"')
        else:
            lines.append("x" * rng.randrange(80))
        want.append(open_now)
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("".join(x + "\n" for x in (lines if name == "a" else lines[:50])), encoding="utf-8")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        raw = jsonl.scan_path(spark, "codex", str(tmp_path))
        rows = raw.filter("source_path like '%/a.jsonl'").orderBy("end_offset").collect()
        assert [r["line"] for r in rows] == lines
        assert [r["context_session_id"] for r in rows] == want
        other = raw.filter("source_path like '%/b.jsonl'").orderBy("end_offset").collect()
        assert [r["context_session_id"] for r in other] == want[:50]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
