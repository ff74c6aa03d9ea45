import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from conftest_llm import documents
from pyspark.sql import functions as F

from sessionloom.llm import importance

FOLD = {c: c + 32 for c in range(65, 91)}


def features(text, low=1, high=1):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return w, [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def expected(docs, target, low=1, high=1, share=(10, 100), least=20):
    bucket = lambda x: zlib.crc32(x.encode()) % 10_000
    seen, wanted = (Counter(bucket(f) for _, t in rows for f in features(t, low, high)[1]) for rows in (docs, target))
    s, t = sum(seen.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1.0) * (s + 10_000.0) / ((seen[b] + 1.0) * (t + 10_000.0))))
    rows = []
    for i, text in docs:
        w, f = features(text, low, high)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], r[1]))
    drawn = Counter()
    for r in able[: share[0] * len(able) // share[1]]:
        drawn[r] += 1
    return rows, drawn, able


def held(spark, docs, target, **options):
    low, high, share, least = options.get("low", 1), options.get("high", 1), options.get("share", (10, 100)), options.get("least", 20)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("old"))
    tf = spark.createDataFrame(target, "item_id long, text string")
    scores = importance.weighted(df, tf, low=low, high=high).drop("text")
    got = [(r.doc_id, r.n_features, r.weight, r.score, r.n_words, r["rank"]) for r in importance.resample(scores, share=share, least_words=least).collect()]
    rows, drawn, able = expected(docs, target, low, high, share, least)
    assert sorted((g[:5] for g in got), key=str) == sorted(rows, key=str)
    ranks = sorted((g for g in got if g[5] is not None), key=lambda g: g[5])
    assert [g[5] for g in ranks] == list(range(1, sum(drawn.values()) + 1))
    assert [g[:5] for g in ranks] == able[: len(ranks)]


def test_documents_equal_brute_force(spark):
    held(spark, documents(spark), documents(spark, name="benchmark", key="item_id"))


@pytest.mark.parametrize("share", [(0, 100), (1, 100), (50, 100), (100, 100)])
def test_runs_of_words_and_shares(spark, share):
    held(spark, documents(spark), documents(spark, name="benchmark", key="item_id"), low=1, high=2, share=share, least=5)


def test_odd_rows(spark):
    words = " ".join(f"wörd{i}" for i in range(30))
    docs = [(1, None), (2, ""), (3, "  "), (4, words), (4, words), (4, words + " more"), (None, words), (None, words), (5, "A-b_C9 \x00x" * 9), (6, " ".join(f"x{i % 7}" for i in range(20_000)))]
    held(spark, docs, [(1, "wörd1 wörd2 A"), (2, None)], share=(60, 100))
    held(spark, docs, [], share=(60, 100))
    held(spark, [], [(1, "a b")])


def test_kth_key_among_many_ties(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"), (F.col("id") + 1).alias("c"))
    order = sorted((r.a, r.b is not None, r.b or 0, r.c) for r in df.collect())
    for k in (1, 2, 1234, 2500, 4999, 5000):
        key = importance.kth_key(df, ["a", "b", "c"], k, pivots=4)
        assert df.where(F.struct("a", "b", "c") <= key).count() == k
        assert df.where(F.struct("a", "b", "c") == key).first().c == order[k - 1][3]
    assert importance.kth_key(df, ["a", "b", "c"], 5001) is None and importance.kth_key(df, ["a", "b", "c"], 0) is None
