"""Decontamination equals a search of all item-sized windows; the blocks find every fingerprint within the radius."""

import random
import re
from collections import Counter

import pytest
from conftest_llm import SF, documents
from pyspark.sql import functions as F

from sessionloom.llm import decontaminate as d

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(docs, items):
    found = {}
    for item, text in items:
        mine = WORD.findall((text or "").lower())
        want, n = shingles(mine), len(mine)
        if n < 5:
            continue
        for doc, body in docs:
            words = WORD.findall((body or "").lower())
            grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
            if not any(g in want for g in grams):
                continue
            for s in range(len(words)):
                have = shingles(words[s : s + n])
                both = sum((have & want).values())
                if both and both / sum((have | want).values()) >= 0.8:
                    key = doc, item
                    found[key] = max(found.get(key, 0), both / sum((have | want).values()))
    return found


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    vocabulary = ["w%d" % i for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(12, 50)))) for i in range(20)] + [(90, "one two"), (91, None), (92, "a a a a a a a a a a a a"), (5, None)]
    docs = []
    for k in range(180):
        body = text(rng.randint(0, 80))
        if k % 3 == 0:
            piece = items[k % 20][1].split()
            for _ in range(rng.randint(0, 1)):
                piece[rng.randrange(len(piece))] = "changed%d" % k
            body = body + [w.upper() for w in piece] + text(20)
        docs.append((k, "\n".join(body)))
    return docs + [(200, None), (201, ""), (None, items[3][1]), (7, items[4][1]), (7, items[4][1]), (202, "a " * 5000)], items


def test_equals_all_windows(spark, planted):
    docs, items = planted
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, hash int")
    bench = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, n int")
    rows = d.contamination(df, bench, F.col("doc_id")).collect()
    got, want = {(r.key, r.item): r.similarity for r in rows}, brute(docs, items)
    assert len(got) == len(rows) and set(got) <= set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(want) > 30 and len(got) >= 0.98 * len(want)
    clean = {(r.doc_id, r.text) for r in d.decontaminated(df, bench).collect()}
    missed = {k for k, _ in set(want) - set(got)}
    dirty = {t for t, _ in brute([(t, t) for _, t in docs], items)} - {t for i, t in docs if i in missed}
    assert clean == {(i, t) for i, t in docs if t not in dirty}
    assert d.contamination(df.limit(0), bench, F.col("doc_id")).count() == 0
    assert d.decontaminated(df, bench.limit(0)).count() == len(docs)


def test_shuffled_search_gives_the_same(spark, planted, monkeypatch):
    docs, items = planted
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set(map(tuple, d.contamination(df, bench, F.col("doc_id")).collect()))
    monkeypatch.setattr(d, "BROADCAST_WORDS", -1)
    assert set(map(tuple, d.contamination(df, bench, F.col("doc_id")).collect())) == want


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        a, flips = rng.getrandbits(64), rng.sample(range(64), d.RADIUS)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        rows.append((k, signed(a), signed(a ^ sum(1 << i for i in flips))))
    df = spark.createDataFrame(rows, "k int, a long, b long")
    shared = df.select(F.size(F.array_intersect(d.block_values(F.col("a"), False), d.block_values(F.col("b"), True))).alias("n")).collect()
    assert all(r.n >= 1 for r in shared)


def test_query(spark):
    got = {(r.doc_id, r.item_id) for r in d.op2_decontamination(spark, SF).collect()}
    assert got == set(brute(documents(spark), documents(spark, name="benchmark", key="item_id"))) and got


@pytest.mark.parametrize("broadcast", [True, False])
def test_every_start_is_tried(spark, monkeypatch, broadcast):
    """Words inserted in the middle and edits at both ends: the best window may be aligned to no shared shingle."""
    if not broadcast:
        monkeypatch.setattr(d, "BROADCAST_STARTS", -1)
    items, docs = [], []
    for item in range(12):
        mine = ["i%dw%d" % (item, k) for k in range(59 - item % 3)]
        items.append((item, " ".join(mine)))
        for at in range(14, 44, 5):
            body = ["x", *mine[1:at], "put", "in", *mine[at:-1], "y"]
            docs.append((len(docs), " ".join(["before"] * (at % 3) + body + ["after"] * (item % 4))))
    want = brute(docs, items)
    found = d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), F.col("doc_id"))
    assert {(r.key, r.item): round(r.similarity, 9) for r in found.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert len(want) > 40


def test_text_full_of_passages(spark):
    """A window of each of its 24,000 starts; with the words of the text beside each of them they took 14 GB of one task."""
    item = ["longerword%02d" % k for k in range(30)]
    docs = spark.createDataFrame([(1, " ".join(item * 800)), (2, "clean")], "doc_id long, text string")
    found = d.contamination(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"), F.col("doc_id"))
    assert [tuple(r) for r in found.collect()] == [(1, 7, 1.0)]


def test_marks_miss_no_digest(spark):
    rows = spark.range(20_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("digest"), (F.col("id") % 100 == 0).alias("wanted"))
    got = d.marked(rows, rows.where("wanted").select("digest"), "digest").groupBy("wanted").agg(F.sum(F.col("marked").cast("int")).alias("n")).collect()
    n = {r.wanted: r.n for r in got}
    assert n[True] == 200 and n[False] <= 20
    assert d.marked(rows, rows.limit(0).select("digest"), "digest").where("marked").count() == 0


def test_clean_texts_are_not_shuffled(spark, planted, monkeypatch):
    docs, items = planted
    monkeypatch.setattr(d, "BROADCAST_STARTS", -1)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made, by, column in ((d.windows(df, d.item_table(bench), F.col("doc_id"), "text"), "digest", "text#"), (d.decontaminated(df, bench), "__key", "__row#")):
            plan = made._jdf.queryExecution().executedPlan().toString()
            shuffled = [part for part in plan.split("Exchange hashpartitioning(%s#" % by)[1:] if column in part.split("Exchange ")[0]]
            assert shuffled and all("bit_get(marks" in part.split("Exchange ")[0] for part in shuffled)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
