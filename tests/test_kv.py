"""Key-value documents: both layouts, resumption."""

import json

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import kv
from sessionloom.plans import ingest

HEADERS = {
    "allComposers": [
        {"composerId": "k1", "lastUpdatedAt": 1000, "workspaceIdentifier": {"id": "wa", "uri": {"fsPath": "/work/a"}}},
        {"composerId": "k2", "lastUpdatedAt": 3000, "workspaceIdentifier": {"id": "wb", "uri": {"fsPath": "/work/b"}}},
        {"composerId": "k3", "lastUpdatedAt": 2000, "workspaceIdentifier": {"id": "wb"}},
        {"composerId": "k4", "lastUpdatedAt": 9000, "workspaceIdentifier": {"id": "../etc"}},
        {"composerId": "", "workspaceIdentifier": {"id": "wc"}},
        {"composerId": "k6"},
    ]
}
PROMPTS = {
    "wa": [{"text": "first"}, {"text": ""}, {"text": "second"}, {"note": 1}, {"text": "first"}, {"text": "third"}],
    "wb": [{"text": "only"}],
    "wz": [{"text": "nobody reads this"}],
}
TIMES = {"wa": [{"unixMs": 11}, {"x": 1}, {"unixMs": 12}, {"unixMs": 13}], "wb": []}


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(None, kv.HEADERS_KEY, HEADERS)]
    for ws, prompts in PROMPTS.items():
        rows.append((ws, kv.PROMPTS_KEY, prompts))
        if ws in TIMES:
            rows.append((ws, kv.GENERATIONS_KEY, TIMES[ws]))
    rows.append(("wa", "unrelated", "x"))
    values = [("u", ws, key, json.dumps(value, ensure_ascii=False)) for ws, key, value in rows]
    return spark.createDataFrame(values, "store string, workspace_id string, key string, value string")


def test_composers(documents):
    found = kv.composers(documents)
    assert {(r["composer_id"], r["fs_path"]) for r in found.collect()} == {("k1", "/work/a"), ("k2", "/work/b"), ("k3", ""), ("k4", "")}
    assert [r["composer_id"] for r in kv.newest_composers(found, 2).collect()] == ["k4", "k2"]
    assert {(r["workspace_id"], r["composer_id"]) for r in kv.owning_composer(found).collect()} == {("wa", "k1"), ("wb", "k2")}


def prompts(df):
    return sorted((r["workspace_id"], r["composer_id"], r["pos"], r["text"], r["ts_ms"]) for r in df.collect())


def test_prompts(documents):
    assert prompts(kv.workspace_prompts(documents)) == [
        ("wa", "k1", 0, "first", 11), ("wa", "k1", 2, "second", 13), ("wa", "k1", 4, "first", 1000), ("wa", "k1", 5, "third", 1000),
        ("wb", "k2", 0, "only", 3000),
    ]


@pytest.mark.parametrize(
    "n_seen, last_text, texts",
    [(1, "second", ["first", "third"]), (1, "first", ["third"]), (1, "third", []), (2, "dropped", ["first", "second", "first", "third"]),
     (3, None, ["first", "third"]), (99, None, [])],
)
def test_resume(spark, documents, n_seen, last_text, texts):
    documents = documents.drop("store")
    seen = spark.createDataFrame([("wa", n_seen, last_text)], "workspace_id string, n_seen int, last_text string")
    got = [p[3] for p in prompts(kv.workspace_prompts(documents, seen)) if p[0] == "wa"]
    assert got == texts


def test_two_stores_do_not_mix(spark, documents):
    other = documents.filter(F.col("workspace_id").isNull() | (F.col("workspace_id") == "wb")).withColumn("store", F.lit("other"))
    both = documents.unionByName(other)
    one, two = kv.workspace_prompts(documents), kv.workspace_prompts(both)
    assert two.count() == one.count() + 1
    assert two.filter("store = 'other'").count() == 1


def test_state(spark, documents):
    documents = documents.drop("store")
    state = kv.workspace_state(documents)
    assert {tuple(r) for r in state.collect()} == {("wa", 6, "third"), ("wb", 1, "only")}
    assert kv.workspace_prompts(documents, state).count() == 0
    older = spark.createDataFrame([("gone", 4, "x")], "workspace_id string, n_seen int, last_text string")
    assert {tuple(r) for r in kv.workspace_state(documents, older).collect()} == {("wa", 6, "third"), ("wb", 1, "only"), ("gone", 4, "x")}


def test_ingest_kv_twice(spark, documents, tmp_path):
    wh = ingest.open_warehouse(spark, str(tmp_path / "wh"))
    ingest.ingest_kv(wh, documents, 0)
    first = wh.ledger().orderBy("source_path", "end_offset").collect()
    assert [r["content"] for r in first] == ["first", "second", "first", "third", "only"]
    ingest.ingest_kv(wh, documents, 1)
    assert wh.ledger().orderBy("source_path", "end_offset").collect() == first
    assert {r["session_id"]: r["next_action"] for r in wh.digests().collect()} == {"k1": "Continue: third", "k2": "Continue: only"}


def test_legacy_layout(spark):
    docs = [
        (None, kv.GENERATIONS_KEY, [{"generationId": "g1", "sessionId": "s", "requestTs": 5, "responseTs": 6, "userMessage": "q", "assistantMessage": "a"}, {}]),
        (None, kv.PROMPTS_KEY, [{"promptId": "p1", "sessionId": "s", "ts": 7, "text": "t"}, {"text": "no id"}, {"promptId": "", "text": "x"}]),
        (None, kv.COMPOSER_DATA_KEY, {"composers": [{"composerId": "c", "sessionId": "s", "messages": [{"content": "m"}, {"role": "assistant", "content": [1], "ts": 8}]}, {"composerId": "n"}]}),
    ]
    df = spark.createDataFrame([(w, k, json.dumps(v)) for w, k, v in docs], "workspace_id string, key string, value string")
    got = sorted((r["msg_id"], r["session_id"], r["role"], r["content"], r["ts_ms"]) for r in kv.legacy_turns(df).collect())
    assert got == sorted([
        ("g1:user", "s", "user", "q", 5), ("g1:assistant", "s", "assistant", "a", 6), (":user", "", "user", "", 0),
        (":assistant", "", "assistant", "", 0), ("p1:user", "s", "user", "t", 7), ("c:msg:0", "s", "user", "m", 0),
        ("c:msg:1", "s", "assistant", "[1]", 8),
    ])
    marks = spark.createDataFrame([(kv.GENERATIONS_KEY, "g1:assistant")], "source_key string, last_msg_id string")
    left = {r["msg_id"] for r in ingest.legacy_kv_turns(df, marks).collect()}
    assert left == {"g1:user", "p1:user", "c:msg:0", "c:msg:1"}


def test_safe_ids(spark):
    ids = {"a-B_9": True, "": False, "a/b": False, "..": False, "a\n": False, "x" * 64: True, "x" * 65: False, "ä": False, None: False}
    rows = spark.createDataFrame([(i,) for i in ids], "i string").select("i", kv.is_safe_id(F.col("i")).alias("ok")).collect()
    assert {r["i"]: r["ok"] for r in rows} == ids


def test_stores_without_headers_are_read_in_the_older_layout(spark, tmp_path):
    wh = ingest.open_warehouse(spark, str(tmp_path / "wh"))
    generation = lambda n: {"generationId": f"g{n}", "sessionId": "s", "requestTs": n, "responseTs": n + 1, "userMessage": f"please do {n}", "assistantMessage": f"did {n}"}
    row = lambda store, key, value: (store, None, key, json.dumps(value))
    schema = "store string, workspace_id string, key string, value string"
    old = [row("old", kv.GENERATIONS_KEY, [generation(1), generation(2)]), row("new", kv.HEADERS_KEY, HEADERS), row("new", kv.GENERATIONS_KEY, [generation(7)])]
    ingest.ingest_kv(wh, spark.createDataFrame(old, schema), 0)
    assert {r["content"] for r in wh.ledger().collect()} == {"please do 1", "did 1", "please do 2", "did 2"}
    ingest.ingest_kv(wh, spark.createDataFrame(old, schema), 1)
    assert wh.ledger().count() == 4
    more = [row("old", kv.GENERATIONS_KEY, [generation(1), generation(2), generation(3)])]
    ingest.ingest_kv(wh, spark.createDataFrame(more, schema), 2)
    assert wh.ledger().count() == 6
    assert [r["next_action"] for r in wh.digests().collect()] == ["did 3"]


def test_growing_composer_loses_no_message(spark, tmp_path):
    """``m:10`` sorts before ``m:9``: ten messages, then thirteen, then one of another composer that sorts first."""
    import json

    from sessionloom.plans import ingest

    def documents(counts):
        composers = [
            {"composerId": c, "sessionId": f"s-{c}", "messages": [{"role": "user", "content": f"{c} {i}", "ts": 1000 + i} for i in range(n)]} for c, n in counts.items()
        ]
        generations = [{"sessionId": "g", "userMessage": f"no id {i}", "assistantMessage": f"re {i}", "requestTs": i, "responseTs": i} for i in range(sum(counts.values()) % 4 + 1)]
        rows = [(None, "composer.composerData", json.dumps({"composers": composers})), (None, "aiService.generations", json.dumps(generations))]
        return spark.createDataFrame(rows, "workspace_id string, key string, value string")

    wh = ingest.open_warehouse(spark, f"{tmp_path}/wh")
    for batch, counts in enumerate(({"b": 10}, {"b": 13}, {"b": 13}, {"b": 13, "a": 2})):
        ingest.ingest_kv(wh, documents(counts), batch)
    said = sorted(r.content for r in wh.ledger().collect())
    assert said == sorted([f"b {i}" for i in range(13)] + [f"a {i}" for i in range(2)] + [f"no id {i}" for i in range(4)] + [f"re {i}" for i in range(4)])


def test_documents_are_computed_once(spark, tmp_path):
    """A batch makes its documents once, however many steps look at them, and leaves no copy of them; documents of a store lie in many tasks."""
    import os

    from sessionloom.session import shared_dir

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    said = '{"composers":[{"composerId":"c%d","sessionId":"s%d","messages":[{"role":"user","content":"hello %d"}]}]}'
    rows = [(None, kv.COMPOSER_DATA_KEY, said % (i, i, i)) for i in range(40)] + [(None, "other.key", "{}"), (None, None, "{}")]
    schema = "workspace_id string, key string, value string"
    documents = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    wh = ingest.open_warehouse(spark, str(tmp_path / "wh"))
    ingest.ingest_kv(wh, documents, 0)
    assert made.value == len(rows)
    assert wh.ledger().count() == 40
    ingest.ingest_kv(wh, documents, 1)
    assert made.value == 2 * len(rows)
    assert wh.ledger().count() == 40
    assert not [f for f in os.listdir(shared_dir(spark).removeprefix("file://")) if f.startswith("kv-")]
