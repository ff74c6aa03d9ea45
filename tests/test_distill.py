"""Distillers against a plain Python model, on random sessions of which one holds most turns; state merging; the cases by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import digest, distill, progress
from test_text import model_cut, model_fences, model_marker, model_questions, split_lines, strip, words

SCHEMA = (
    "session_id string, tool string, ts_ms bigint, role string, content string, tool_calls_json string, files_touched_json string, "
    "source_path string, end_offset bigint"
)
PIECES = [
    "fix it", "TODO: one", "TODO:  one", "FIXME two", "why not?", "Really? Yes. Sure?", "ok", "```", "code", "Error here", "let me try again",
    "XXX", "panic!", "long " * 40, "日本 語?", "  ", "plain answer.",
]


def random_turns(seed, n=900):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        session = rng.choices(["hot", "s1", "s2", "s3", "s4"], [12, 1, 1, 1, 1])[0]
        role = rng.choice(["user", "assistant", "assistant", "tool_result", "system"])
        content = rng.choice(["\n", "\r\n", " "]).join(rng.choice(PIECES) for _ in range(rng.randrange(0, 5)))
        if rng.random() < 0.2:
            content = json.dumps([{"type": "text", "text": content}, {"type": "tool_use"}])
        elif rng.random() < 0.05:
            content = "[not json"
        calls = '[{"x":1}]' if session != "s4" and rng.random() < 0.2 else None
        files = rng.choice([None, None, json.dumps([f"f{rng.randrange(25)}", f"g{rng.randrange(3)}"]), "[oops", '["a",1]', "[]"]) if calls else None
        # Equal times are common; the position in the source decides.
        rows.append((session, "claude", 1_700_000_000_000 + rng.randrange(0, 400) * 700, role, content, calls, files, f"p{rng.randrange(2)}", i))
    return rows


def blocks(text):
    try:
        items = json.loads(text)
    except ValueError:
        return None
    found = [x["text"] for x in items if isinstance(x, dict) and x.get("type") == "text" and isinstance(x.get("text"), str)]
    return "\n".join(found) or None


def said(role, content):
    body = strip(content)
    if role not in ("user", "assistant") or not body:
        return None
    if not body.startswith("["):
        return body
    return blocks(body) if role == "assistant" else None


def first_line(text):
    return next((strip(x) for x in split_lines(text) if strip(x)), "")


def distinct(values, limit, cut):
    out = {}
    for v in values:
        canonical = " ".join(words(v))
        if canonical and canonical not in out:
            out[canonical] = model_cut(canonical, cut)
    return list(out.values())[:limit]


def iso(ms):
    from datetime import datetime, timezone

    return datetime.fromtimestamp(ms // 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def model(turns):
    turns = sorted(turns, key=lambda r: (r[2], r[7], r[8]))
    prose = [(r, said(r[3], r[4])) for r in turns]
    task = next((model_cut(first_line(p), 120) for r, p in prose if r[3] == "user" and p and len(p.encode()) >= 10), "<no task captured>")
    answer = next((model_cut(a, 2000) for r, p in reversed(prose) if r[3] == "assistant" and p and (a := model_fences(p))), None)
    ask = next(("Continue: " + model_cut(first_line(p), 1990) for r, p in reversed(prose) if r[3] == "user" and p), None)
    questions = []
    for _, p in prose:
        for line in split_lines(p or ""):
            questions += [m for w in ("TODO", "FIXME", "XXX") if (m := model_marker(line, w))] + model_questions(line)
    failed = []
    for r in turns:
        low = r[4].lower()
        errors = ("error", "failed", "exception", "traceback", "panic", "sigsegv")
        retries = ("retry", "tried", "didn't work", "doesn't work", "still failing", "let me try", "approach 2", "next attempt")
        if (r[3] == "tool_result" and any(w in low for w in errors)) or (r[3] == "assistant" and any(w in low for w in retries)):
            failed.append(first_line(r[4]))
    files = {}
    for i, r in enumerate(turns):
        try:
            paths = json.loads(r[6] or "null")
        except ValueError:
            continue
        if isinstance(paths, list) and all(isinstance(x, str) for x in paths):
            files.update({x: i for x in paths})
    entries = [f"- [{iso(r[2])}] [{r[3]}] {model_cut(first_line(p), 150)}" for r, p in prose if p and first_line(p)]
    return {
        "task": task,
        "next_action": answer or ask or "<no next action captured>",
        "open_questions": distinct(questions, 5, 80),
        "failed_approaches": distinct(failed, 3, 80) if any(r[5] for r in turns) else [],
        "recent_files": [x for x, _ in sorted(files.items(), key=lambda kv: (-kv[1], kv[0]))][:10],
        "progress_entries": list(dict.fromkeys(entries)),
        "timestamp_iso": iso(max(r[2] for r in turns)),
    }


def as_dicts(df):
    return {r["session_id"]: {k: v for k, v in r.asDict().items() if k not in ("session_id", "source_tool")} for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_model(spark, seed):
    rows = random_turns(seed)
    led = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = {s: model([r for r in rows if r[0] == s]) for s in {r[0] for r in rows}}
    assert as_dicts(digest.session_digest(led)) == want
    lists = {"open_questions": distill.open_questions, "failed_approaches": distill.failed_approaches, "recent_files": distill.recent_files}
    for name, fn in lists.items():
        got = {}
        for r in fn(led).orderBy("session_id", "rank").collect():
            got.setdefault(r["session_id"], []).append(r[2])
        assert got == {s: d[name] for s, d in want.items() if d[name]}, name
    assert {r["session_id"]: r["task"] for r in distill.task(led).collect()} == {s: d["task"] for s, d in want.items()}
    assert {r["session_id"]: r["next_action"] for r in distill.next_action(led).collect()} == {s: d["next_action"] for s, d in want.items()}


def test_states_merge(spark):
    """Digesting batch by batch, in any order, gives what digesting everything gives."""
    rows = random_turns(3)
    rng = random.Random(8)
    batches = [[] for _ in range(5)]
    for r in rows:
        rng.choice(batches).append(r)
    states = [digest.session_state(spark.createDataFrame(b, SCHEMA)) for b in batches]
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    once = digest.session_state(union_source := spark.createDataFrame(rows, SCHEMA))
    whole = as_dicts(digest.session_digest(union_source))
    assert as_dicts(digest.assemble(union)) == whole
    assert as_dicts(digest.assemble(once)) == whole
    assert as_dicts(digest.assemble(union.unionByName(states[2]))) == whole


def test_render(spark):
    schema = "session_id string, source_tool string, timestamp_iso string, task string, next_action string, open_questions array<string>, recent_files array<string>, failed_approaches array<string>, progress_entries array<string>, session_activity array<string>, git_context string"
    full = ("s", "codex", "T", "do it", "line one\nline two", ["q?"], ["a.rs"], ["bad"], [f"- e{i}" for i in range(3)], ["- x (1s ago)"], "HEAD: abc")
    bare = ("n", "codex", "T", "<no task captured>", "<no next action captured>", [], [], [], [], [], "<no git context>")
    long = ("l", *full[1:8], [f"- e{i}" for i in range(400)], *full[9:])
    body = {r["session_id"]: r["body"] for r in digest.render_digest(spark.createDataFrame([full, bare, long], schema)).collect()}
    assert body["s"].split("\n") == [
        "# Last updated T from codex", "", "## Task", "- [T] do it", "", "## Session activity", "- x (1s ago)", "", "## Recent files", "- a.rs", "",
        "## Failed approaches", "- bad", "", "## Open questions", "- q?", "", "## Next action", "- [T] line one", "", "## Git context", "HEAD: abc", "",
        "## Progress log", "<!-- session: s -->", "# Progress Log", "- e0", "- e1", "- e2", "", "## What to do next", "line one", "line two", "",
    ]
    assert [x for x in body["n"].split("\n") if x.startswith("## ")] == ["## Task", "## Next action", "## Progress log", "## What to do next"]
    lines = body["l"].split("\n")
    assert len(lines) == 151 and lines[149] == "…(truncated)" and lines[150] == ""


def test_progress_and_history(spark):
    schema = "project string, entry string, ord bigint"
    log = [("p", "- [2024-01-01T00:00:02Z] [user] b", 2), ("p", "- [2024-01-01T00:00:01Z] [user] a", 1)]
    new = [("p", "- [2024-01-01T00:00:02Z] [user] same second", 3), ("p", "- [2024-01-01T00:00:03Z] [user] c", 4),
           ("p", "- [2024-01-01T00:00:03Z] [user] c", 5), ("q", "- [2020-01-01T00:00:00Z] [user] first", 6), log[0]]
    existing, batch = spark.createDataFrame(log, schema), spark.createDataFrame(new, schema)
    got = {(r["project"], r["entry"][-11:], r["ord"]) for r in progress.merge_progress(existing, batch).collect()}
    assert got == {("p", "Z] [user] c", 4), ("q", "[user] first"[-11:], 6)}
    lenient = {r["entry"].rsplit("] ", 1)[1] for r in progress.merge_progress(existing, batch, allowed_lateness_s=5).collect()}
    assert lenient == {"same second", "c", "first"}
    values = [("p", "task", "x\ny", 3), ("p", "task", " x ", 1), ("p", "task", "<no task captured>", 2), ("p", "task", "  ", 2), ("p", "task", "z", 2)]
    v = spark.createDataFrame(values, "project string, section string, value string, ts_ms bigint")
    rows = progress.history(v)
    assert {(r["value"], r["first_seen_ms"]) for r in rows.collect()} == {("x", 1), ("z", 2)}
    assert [r["bullet"][-1] for r in progress.newest_history(rows).orderBy("rank").collect()] == ["z", "x"]
    assert progress.history_delta(rows, v).count() == 0
    kept = progress.last_non_empty(spark.createDataFrame([("k", "a", 1), ("k", "", 2), ("m", "", 1)], "k string, v string, n int"), "k", "v", F.col("n"))
    assert {tuple(r) for r in kept.collect()} == {("k", "a"), ("m", None)}


def test_empty_input(spark):
    led = spark.createDataFrame([], SCHEMA)
    assert digest.render_digest(digest.session_digest(led)).count() == 0
    for fn in (distill.task, distill.next_action, distill.open_questions, distill.failed_approaches, distill.recent_files, distill.progress_entries):
        assert fn(led).count() == 0
