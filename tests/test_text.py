"""Text expressions against plain Python models on random strings, and the boundary cases by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import redact as rd
from sessionloom.functions import text as tx
from sessionloom.functions import variant as vr

WORDS = ["alpha", "TODO", "TODO:", "FIXME::", "XXX", "_TODO", "TODOs", "what?", "yes.", "no!", "ünï", "日本", "```", "```rust", "  ```", "-", ":", "a_b", "?"]
GAPS = [" ", "  ", "\n", "\r\n", "\t", " ", "　", "\n\n", "\x0b", " ", "\x85"]


def random_texts(n=1500, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(rng.randrange(0, 14))) + rng.choice(["", "end", "end?"]) for _ in range(n)]


def is_blank(ch):
    return ch in tx.BLANKS


def strip(s):
    return s.strip(tx.BLANKS)


def split_lines(s):
    out = s.split("\n")
    return [x[:-1] if x.endswith("\r") and i < len(out) - 1 else x for i, x in enumerate(out)]


def words(s):
    out, cur = [], ""
    for ch in s:
        if is_blank(ch):
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += ch
    return out + [cur] if cur else out


def model_cut(s, n):
    if len(s) <= n:
        return s
    p = s[:n]
    at = max((i for i, ch in enumerate(p) if is_blank(ch)), default=None)
    return (p if at is None else p[:at].rstrip(tx.BLANKS)) + "…"


def model_fences(s):
    out, held, inside = [], [], False
    for line in split_lines(s):
        if line.lstrip(tx.BLANKS).startswith("```"):
            if inside:
                held = []
            inside = not inside
        elif inside:
            held.append(line)
        else:
            out.append(line)
    return strip("\n".join(out + (held if inside else [])))


def model_questions(line):
    out, cur = [], ""
    for i, ch in enumerate(line):
        cur += ch
        if ch in ".!?" and (i + 1 == len(line) or is_blank(line[i + 1])):
            out.append(strip(cur))
            cur = ""
    out.append(strip(cur))
    return [s for s in out if s.endswith("?")]


def model_marker(line, word):
    bound = lambda ch: ch.isascii() and (ch.isalnum() or ch == "_")
    at = line.find(word)
    while at >= 0:
        after = at + len(word)
        if not (at and bound(line[at - 1])) and not (after < len(line) and bound(line[after])):
            return strip(line[after:].lstrip(":")) or None
        at = line.find(word, at + 1)
    return None


def test_random_strings(spark):
    texts = random_texts()
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(
        "t",
        tx.trim(t).alias("trim"),
        tx.first_line(t).alias("first"),
        tx.collapse(t).alias("collapse"),
        tx.truncate_at_word(t, 12).alias("cut"),
        tx.strip_code_fences(t).alias("fences"),
        tx.lines(t).alias("lines"),
        F.transform(tx.lines(t), tx.question_sentences).alias("asked"),
        F.transform(tx.lines(t), lambda x: tx.marker_capture(x, "TODO")).alias("todo"),
    )
    for r in rows.collect():
        s = r["t"]
        assert r["trim"] == strip(s)
        assert r["first"] == next((strip(x) for x in split_lines(s) if strip(x)), "")
        assert r["collapse"] == " ".join(words(s))
        assert r["cut"] == model_cut(s, 12)
        assert r["fences"] == model_fences(s), repr(s)
        assert r["lines"] == split_lines(s)
        assert r["asked"] == [model_questions(x) for x in split_lines(s)]
        assert r["todo"] == [model_marker(x, "TODO") for x in split_lines(s)]


@pytest.mark.parametrize(
    "text, limit, want",
    [("a" * 120, 120, "a" * 120), ("a" * 121, 120, "a" * 120 + "…"), ("ab cd ef", 5, "ab…"), (" abcdef", 3, "…"), ("日本 語語", 3, "日本…"), ("", 3, "")],
)
def test_truncate(spark, text, limit, want):
    assert spark.range(1).select(tx.truncate_at_word(F.lit(text), limit)).first()[0] == want


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(tx.format_age(F.lit(n))) for n in (0, 59, 60, 3599, 3600, 90000)] == ["0s ago", "59s ago", "1m ago", "59m ago", "1h ago", "25h ago"]
    assert one(tx.ms_to_iso(F.lit(1700000000999))) == "2023-11-14T22:13:20Z"
    assert one(tx.section(F.lit("x\n## Task\n- a\n\n## Next\nq"), "Task")) == "- a"
    assert one(tx.section(F.lit("x\n## Next\nq"), "Task")) == ""
    assert one(tx.section(F.lit("## Task\nfirst\n## Next\nq\n## Task\nsecond"), "Task")) == "first"
    assert one(tx.section(F.lit("## Task\nlast"), "Task")) == "last"
    assert one(tx.bullet_ts(F.lit("- [2024] v"))) == "2024"
    assert one(tx.bullet_value(F.lit("- [2024] [user] v "))) == "[user] v"
    assert one(tx.hard_truncate(F.lit("x" * 201), 200, "…")) == "x" * 200 + "…"


@pytest.mark.parametrize(
    "line, good",
    [('{"a":1}', True), ('{"a":1} x', False), ('{"a":1}{"b":2}', False), ('{"a":1},{"b":2}', False), ('{"a":1}] junk', False),
     ('{"a":', False), ("", False), ('{"a":1,"a":2}', True), ('[1,"x"]', True), ("null", True), ("{'a':1}", False)],
)
def test_strict_json(spark, line, good):
    assert (spark.range(1).select(vr.parse_strict(F.lit(line)).isNotNull()).first()[0]) is good


@pytest.mark.parametrize(
    "value, want",
    [(1700000000000, 1700000000000), ("1700000000000", 1700000000000), ("2026-04-28T08:35:19.123Z", 1777365319123),
     ("2026-04-28T10:35:19.123+02:00", 1777365319123), (1.5, None), ("2026-04-28", None), ("2026-04-28T08:35:19", None), ("soon", None),
     (None, None), (True, None), (2**70, None)],
)
def test_timestamps(spark, value, want):
    v = vr.parse_strict(F.lit(json.dumps({"t": value})))
    assert spark.range(1).select(vr.timestamp_any(vr.get(v, ".t"))).first()[0] == want


def test_text_blocks(spark):
    docs = {
        '[{"type":"text","text":"A"},{"type":"tool_use","text":"no"},"s",{"type":"text","text":5},{"type":"text","text":"B"}]': "A\nB",
        '[{"type":"tool_use"}]': None, "[not json": None, '[{"type":"text","text":""}]': None,
    }
    rows = spark.createDataFrame([(d,) for d in docs], "d string").select("d", vr.text_blocks(F.col("d")).alias("b"))
    assert {r["d"]: r["b"] for r in rows.collect()} == docs


def test_redaction_rules(spark):
    lines = {
        "key sk-" + "a" * 24: "key sk-REDACTED",
        "A" + "KIA" + "Z" * 16 + " x": "AKIA" + "X" * 16 + " x",
        "xo" + "xp-12345-abcde": "xoxb-REDACTED",
        "AWS_SECRET_ACCESS_KEY = " + "a" * 40: "AWS_SECRET_ACCESS_KEY = REDACTED",
        "Authorization: Bearer abc.def==": "Authorization: Bearer REDACTED",
        "PASSWORD=hunter2 rest": "PASSWORD=REDACTED rest",
        "paſſword: x": "paſſword: REDACTED",
        'token = "abcdefghij"': 'token = "abcdefghij"',
        "to\u212aen=abcdefgh1": "to\u212aen=REDACTED",
        "mail a@b.com_foo@x.org now": "mail user@example.invaliduser@example.invalid now",
        "/home/ann/x.rs then /home/ann/y.rs, /home/ann/x.rs /Users/bo": "/synthetic/path/1 then /synthetic/path/2, /synthetic/path/1 /synthetic/path/3",
        # One rule after the other: "/home/b" goes first, then "/Users/a/synthetic/path/1", then the drive path up to "\\d".
        "C:\\Users\\eve\\d\\f.txt and /Users/a/home/b": "/synthetic/path/3\\f.txt and /synthetic/path/2",
        "plain": "plain",
    }
    df = spark.createDataFrame([(k, k) for k in lines], "raw string, text string")
    once = rd.redact(df, "text")
    assert {r["raw"]: r["text"] for r in once.collect()} == lines
    # Clean text stays as it is (two addresses run together read as one address afterwards).
    again = rd.redact(once.filter("raw not like 'mail%'"), "text").collect()
    assert all(r["text"] == lines[r["raw"]] for r in again)


def test_run_numbering(spark):
    """Numbers go on over rows, in row order; a path around a replaced one is one path wherever it occurs."""
    from sessionloom.operators.redaction import redact_run

    texts = {
        5: "/home/z/1 /Users/b/home/c again /home/z/1",
        1: "none",
        2: "/Users/b/x and /home/z/1",
        7: "/home/q /Users/b/home/c C:\\Users\\d",
        6: "/Users/b/x",
    }
    df = spark.createDataFrame(list(texts.items()), "id int, text string").repartition(3)
    got = {r["id"]: r["text"] for r in redact_run(df, "id", "text").collect()}
    p = "/synthetic/path/"
    # Row 2: home first (1), then Users (2). Row 5: /home/z/1 is 1, /home/c is 3, the path around it 4. Row 7: /home/q is 5, drive path 6.
    assert got == {1: "none", 2: f"{p}2 and {p}1", 5: f"{p}1 {p}4 again {p}1", 6: f"{p}2", 7: f"{p}5 {p}4 {p}6"}
