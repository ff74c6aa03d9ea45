"""Project documents, their files, and the refresh of file activity."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import normalize, project
from sessionloom.plans import ingest
from sessionloom.sources import documents

DIGEST = "project string, session_id string, source_tool string, timestamp_iso string, next_action string, open_questions array<string>, recent_files array<string>, failed_approaches array<string>"


def latest(spark, *rows):
    return spark.createDataFrame(list(rows), DIGEST)


def bodies(spark, digests, history=(), log=(), activity=(), git=()):
    lines = project.document_lines(
        project.newest_digests(digests),
        spark.createDataFrame(list(history), "project string, section string, value string, first_seen_ms bigint"),
        spark.createDataFrame(list(log), "project string, entry string, ord bigint"),
        spark.createDataFrame(list(activity), "project string, rank int, line string"),
        spark.createDataFrame(list(git), "project string, git_context string"),
    )
    return {r.project: r.body for r in project.render_documents(lines).collect()}


def test_all_sections_in_order(spark):
    old = ("p", "s0", "codex", "2024-01-01T00:00:00Z", "old", ["never shown"], [], [])
    new = ("p", "s1", "claude", "2024-01-02T00:00:00Z", " do it\nthen that ", ["why?"], ["a.rs", "b.rs"], ["boom"])
    found = bodies(
        spark, latest(spark, old, new),
        [("p", "task", "first", 0), ("p", "task", "second", 1000), ("p", "next_action", "do it", 1000), ("q", "task", "other", 0)],
        [("p", "- e2", 2), ("p", "- e1", 1), ("q", "- no", 1)], [("p", 2, "- y"), ("p", 1, "- x")], [("p", "HEAD: c0ffee"), ("q", "HEAD: 1")],
    )
    assert found == {"p": "\n".join([
        "# Last updated 2024-01-02T00:00:00Z from claude", "", "## Task", "- [1970-01-01T00:00:01Z] second", "- [1970-01-01T00:00:00Z] first", "",
        "## Session activity", "- x", "- y", "", "## Recent files", "- a.rs", "- b.rs", "", "## Failed approaches", "- boom", "", "## Open questions", "- why?", "",
        "## Next action", "- [1970-01-01T00:00:01Z] do it", "", "## Git context", "HEAD: c0ffee", "",
        "## Progress log", "<!-- session: s1 -->", "# Progress Log", "- e1", "- e2", "", "## What to do next", "do it", "then that", "",
    ])}


def test_empty_sections_and_long_log(spark):
    one = ("p", "s", "claude", "2024-01-01T00:00:00Z", "", [], [], [])
    body = bodies(spark, latest(spark, one), log=[("p", f"- e{i:04d}", i) for i in range(400)], git=[("p", "<no git context>")])["p"]
    lines = body.split("\n")
    assert lines[:6] == ["# Last updated 2024-01-01T00:00:00Z from claude", "", "## Task", "", "", "## Next action"]
    assert len(lines) == 151 and lines[149] == "…(truncated)" and lines[150] == "" and "Git" not in body
    assert bodies(spark, latest(spark)) == {}


def read(folder):
    out = {}
    for top, _, names in os.walk(folder):
        for n in names:
            if not n.startswith("."):
                out[os.path.relpath(os.path.join(top, n), folder)] = open(os.path.join(top, n), encoding="utf-8").read()
    return out


def test_files_are_replaced_as_a_whole(spark, tmp_path):
    folder = f"{tmp_path}/out dir"
    rows = lambda n: spark.range(n).select(F.lit("/work/../p ä").alias("project"), F.lit("a.md").alias("file"), F.col("id").alias("pos"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("line"))
    documents.write_files(rows(5000).repartition(5), ["pos"], folder)
    name = "project=%2Fwork%2F..%2Fp%20%C3%A4/a.md"
    assert read(folder) == {name: "".join(f"é{i}\n" for i in range(5000))}
    documents.write_files(rows(2), ["pos"], folder)
    assert read(folder) == {name: "é0\né1\n"}
    broken = rows(3).unionByName(rows(1).withColumns({"project": F.lit("z"), "line": F.raise_error(F.lit("lost")).cast("string")}))
    with pytest.raises(Exception, match="lost"):
        documents.write_files(broken, ["pos"], folder)
    assert read(folder) == {name: "é0\né1\n"}


def store(wh, spark, batch, rows):
    columns = "session_id string, ts_ms bigint, role string, content string"
    df = spark.createDataFrame(rows, columns).withColumns({
        "tool": F.lit("claude"), "source_path": F.lit("f"), "end_offset": F.col("ts_ms"), "status": F.lit("ok"), "project_dir": F.lit("/work/p")
    })
    ingest.store_batch(wh, normalize.finish(df), "claude", batch)


def test_activity_is_refreshed_without_turns_and_kept_when_nothing_is_recent(spark, tmp_path):
    wh = ingest.open_warehouse(spark, f"{tmp_path}/wh")
    store(wh, spark, 0, [("s", 1000, "user", "please write the importer"), ("s", 2000, "assistant", "Done. Now test it.")])
    at = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)
    files = lambda *x: spark.createDataFrame([("/work/p", p, at - dt.timedelta(hours=h)) for p, h in x], "project string, path string, mtime timestamp")
    ingest.digest_batch(wh, "claude", 0, files(("a.rs", 1)), F.lit(at))
    for batch, listing in ((1, files(("a.rs", 2), ("b.rs", 0))), (2, files(("a.rs", 9))), (3, files())):
        ingest.digest_batch(wh, "claude", batch, listing, F.lit(at))
        assert [r.line for r in wh.activity().orderBy("rank").collect()] == ["- b.rs (0s ago)", "- a.rs (2h ago)"]
    store(wh, spark, 4, [("t", 9000, "user", "now write the exporter"), ("t", 9500, "assistant", "Exported. Ship it.")])
    ingest.digest_batch(wh, "claude", 4)
    git = spark.createDataFrame([("/work/p", "0123456789", " a | 1 +\n 1 file changed\n")], "project string, head string, diffstat string")
    ingest.publish(wh, f"{tmp_path}/docs", git)
    made = read(f"{tmp_path}/docs")
    assert set(made) == {"project=%2Fwork%2Fp/digest.md", "project=%2Fwork%2Fp/progress.md"}
    body = made["project=%2Fwork%2Fp/digest.md"]
    assert "] now write the exporter\n- [1970-01-01T00:00:02Z] please write the importer\n" in body and "HEAD: 01234567; diff: 1 file changed" in body and "- b.rs (0s ago)" in body
    assert made["project=%2Fwork%2Fp/progress.md"].count("\n- [") == 4
