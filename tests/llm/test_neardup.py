"""Near-duplicates against all pairs; the sampling against its probability; components against union-find."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import SF, documents

from sessionloom.llm import neardup as nd
from sessionloom.llm.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fold(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def bag(text):
    w = WORD.findall(fold(text))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def brute(docs, idf):
    bags = [bag(t) for _, t in docs]
    weight = {}
    for b in bags:
        for s in b:
            if s not in weight:
                raw = np.frombuffer(b" ".join(s), np.uint8)
                h, _ = nd.shingles(raw, np.array([0, len(raw)]))
                weight[s] = float(idf[nd.bucket(h)][0])
    union, where = Union(), {}
    for k, b in enumerate(bags):
        for s in b:
            where.setdefault(s, []).append(k)
    seen = set()
    for k, b in enumerate(bags):
        for o in {o for s in b for o in where[s] if o < k}:
            if (o, k) not in seen:
                seen.add((o, k))
                both, either = bags[o] & b, bags[o] | b
                total = lambda c: sum(n * weight[s] for s, n in c.items())
                if total(both) >= (nd.SIMILARITY - 1e-4) * total(either):
                    union.join(o, k)
    texts = {}
    for k, (_, t) in enumerate(docs):
        union.join(texts.setdefault(t or "", k), k)
    groups = {}
    for k, (i, _) in enumerate(docs):
        groups.setdefault(union.find(k), []).append(i)
    return sorted((tuple(sorted(g, key=str)) for g in groups.values()), key=str)


def classes(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.class_id, []).append(r.doc_id)
    return sorted((tuple(sorted(g, key=str)) for g in groups.values()), key=str)


def planted(n=90, seed=3):
    rng = random.Random(seed)
    text = lambda k: [rng.choice("abcdefghijk") + str(rng.randrange(90)) for _ in range(k)]
    docs = []
    for i in range(n):
        base = text(rng.randrange(60, 160))
        docs.append((len(docs), " ".join(base)))
        for _ in range(rng.choice((0, 0, 1, 3))):
            near = list(base)
            for _ in range(rng.randrange(1, 4)):
                near[rng.randrange(len(near))] = "edit" + str(rng.randrange(99))
            docs.append((len(docs), "\n".join(near).upper() if rng.random() < 0.2 else " ".join(near)))
    base = text(200)
    for _ in range(60):  # a large group of near copies
        near = list(base)
        near[rng.randrange(200)] = "edit" + str(rng.randrange(999))
        docs.append((len(docs), " ".join(near)))
    docs += [(len(docs) + k, t) for k, t in enumerate(["", "a", "a b c", "A b c", "x " * 3000, "  \n"])]
    return docs + [(3000, docs[0][1]), (3001, docs[0][1]), (4000, "a b c")]


@pytest.mark.parametrize("block", [256, 8])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    docs = planted()
    df = spark.createDataFrame([(*d, b"k", 1) for d in docs], "doc_id long, text string, key binary, class_size int")
    rows = nd.classified(df, "doc_id").collect()
    assert classes(rows) == brute(docs, nd.inverse_frequencies(df))
    assert sum(len(c) > 1 for c in classes(rows)) > 20 and max(map(len, classes(rows))) >= 60
    assert all(r.class_size == sum(x.class_id == r.class_id for x in rows) for r in rows)


def test_filter_keeps_one_of_each(spark):
    docs = planted(20) + [(None, None), (None, None), (7, "same row " * 9), (7, "same row " * 9)]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, __key int")
    kept = nd.deduplicated(df).collect()
    assert nd.deduplicated(df).columns == df.columns
    assert len(kept) == len(brute([(k, t) for k, (_, t) in enumerate(docs)], nd.inverse_frequencies(df)))
    assert sum(r.doc_id == 7 and r.text.startswith("same") for r in kept) == 1
    assert nd.deduplicated(df.limit(0)).count() == 0


def test_query(spark):
    rows = nd.op6_near_duplicates(spark, SF).collect()
    docs = documents(spark)
    idf = nd.inverse_frequencies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert classes(rows) == brute(docs, idf)
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_samples_agree_as_often_as_similarity():
    rng = np.random.default_rng(0)
    agree, want = [], []
    for _ in range(60):
        h = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        a, b = rng.uniform(0.5, 3, 120), rng.uniform(0.5, 3, 120)
        a[:20], b[20:30] = 0, 0
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        rows, both = [], []
        for w in (a, b):
            keep = np.flatnonzero(w)
            keep = keep[np.argsort(h[keep])]
            both.append(nd.signatures(h[keep], np.zeros(len(keep), np.int64), w[keep], 1)[0])
        agree.append((both[0] == both[1]).mean())
    assert abs(np.mean(agree) - np.mean(np.array(want) ** nd.ROWS)) < 0.05


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    union = Union()
    for a, b in links:
        union.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: union.find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
