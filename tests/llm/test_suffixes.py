"""Suffix dedup equals a count of all 200-byte strings; the sort equals Python's."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from conftest_llm import SF, documents

from sessionloom.llm import repeats, suffixes


def brute(docs, window=suffixes.WINDOW):
    raw = [(i, (t or "").encode()) for i, t in docs]
    many = Counter()
    for _, b in raw:
        many.update(hashlib.md5(b[s : s + window]).digest() for s in range(len(b) - window + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if many[hashlib.md5(b[s : s + window]).digest()] > 1:
                gone[s : s + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def planted(seed=0, n=100):
    rng = random.Random(seed)
    letters = "abcdefghij é\n"
    text = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passage = [text(k) for k in (180, 199, 200, 201, 300, 700)]
    docs = []
    for i in range(n):
        t = text(rng.randrange(500))
        if i % 2:
            cut = rng.randrange(len(t) + 1)
            t = t[:cut] + rng.choice(passage) + t[cut:]
        if i % 9 == 3:
            p = list(passage[5])
            p[rng.randrange(700)] = "X"
            t += "".join(p)
        docs.append((i, t))
    docs += [(i + 1000, docs[i][1]) for i in range(0, 30, 7)]
    docs += [(None, None), (2000, ""), (2001, "short"), (2002, "x" * 1500), (2003, "ab" * 300 + "c"), (2004, docs[1][1]), (2004, docs[1][1]), (None, docs[5][1])]
    return docs


def test_sort():
    rng = random.Random(2)
    for size, alphabet in ((300, b"ab"), (200, b"abc\x00"), (120, b"a")):
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(90))) for _ in range(size)]
        texts += [t + b"z" for t in texts[:40]] + texts[:20] + [b"a" * 40 + t for t in texts[:50]]
        group = np.array([rng.randrange(3) for _ in texts])
        data = np.frombuffer(b"".join(texts) + b"\x00", np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        order, shared = suffixes.deep_shallow(data, ends - [len(t) for t in texts], ends, group)
        keys = [(group[r], texts[r]) for r in order]
        assert keys == sorted(keys)
        for k in range(1, len(order)):
            same = keys[k][0] == keys[k - 1][0]
            assert shared[k] == (len(os.path.commonprefix([keys[k][1], keys[k - 1][1]])) if same else 0)


@pytest.mark.parametrize("hot", [256, 2])
def test_equals_counting_all(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = planted()
    df = spark.createDataFrame([(*d, b"k", 3) for d in docs], "doc_id long, text string, key binary, a int")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(df).collect()]
    assert sorted(got, key=str) == brute(docs)
    assert sum(r[2] > 0 for r in got) > 30
    assert suffixes.without_repeats(df.limit(0)).count() == 0


def test_query(spark):
    got = [tuple(r) for r in suffixes.op3_suffix_dedup(spark, SF).collect()]
    assert sorted(got, key=str) == brute(documents(spark))
