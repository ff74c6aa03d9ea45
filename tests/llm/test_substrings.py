"""Substring dedup equals a count of all windows."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import SF, documents

from sessionloom.llm import repeats, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window=substrings.WINDOW):
    many = Counter()
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    for _, w in split:
        many.update(tuple(w[s : s + window]) for s in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if many[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def planted(seed=0, n=150):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    passage = [[word() for _ in range(k)] for k in (34, 35, 36, 60, 120)]
    docs = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(90))]
        if i % 2:
            cut = rng.randrange(len(w) + 1)
            w = w[:cut] + rng.choice(passage) + w[cut:]
        if i % 10 == 3:
            p = list(passage[4])
            p[rng.randrange(120)] = "edit"
            w += p
        docs.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    docs += [(i + 1000, docs[i][1]) for i in range(0, 40, 7)]
    docs += [(None, None), (2000, ""), (2001, "one two"), (2002, "x " * 300), (2003, "é ü " * 30), (2004, docs[1][1]), (2004, docs[1][1]), (None, docs[5][1])]
    return docs


@pytest.mark.parametrize("hot", [256, 2])
def test_equals_counting_all(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = planted()
    df = spark.createDataFrame([(*d, b"k", 3) for d in docs], "doc_id long, text string, key binary, a int")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.without_repeats(df).collect()]
    assert sorted(got, key=str) == brute(docs)
    assert sum(r[2] > 0 for r in got) > 40
    assert substrings.without_repeats(df.limit(0)).count() == 0


def test_query(spark):
    got = [tuple(r) for r in substrings.op4_substring_dedup(spark, SF).collect()]
    assert sorted(got, key=str) == brute(documents(spark))


def test_buckets_are_hashed_in_little_memory():
    rng = np.random.default_rng(5)
    many = [b" ".join(b"%d" % x for x in rng.integers(0, 1000, 40)) for _ in range(50)]
    payload = [many[k] for k in rng.integers(0, 50, 50_000)]  # some 8 MB
    rows = len(payload)
    packs = pa.table({"hash": np.full(rows, 7), "key": pa.array([b"k"] * rows, pa.binary()), "payload": pa.array(payload, pa.binary())})
    repeats.distinct_packs(packs.slice(0, 10))  # makes the tables of powers
    tracemalloc.start()
    first, which, n = repeats.distinct_packs(packs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(first) == 50 and n.sum() == rows and all(payload[first[k]] == p for k, p in zip(which.tolist(), payload))
    assert peak < 100 << 20
