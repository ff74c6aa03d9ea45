import re

import numpy as np
import pytest
import xxhash
from conftest_llm import documents

from sessionloom.llm import golay


def fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Components by comparison of all pairs."""
    values = np.array(sorted(set(prints)), np.uint64)
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return {int(v): find(i) for i, v in enumerate(values)}


def expected(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = classes(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints)), key=str)


def run(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df, sorted((tuple(r) for r in golay.with_components(golay.fingerprinted(df).drop("text")).select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_code_is_perfect_and_near_keys_cover_one_bit():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    near, size = golay.near_keys(words)
    assert set(size) <= {1, 6}
    for bit in range(23):
        other, _ = golay.near_keys(words ^ (1 << bit))
        assert all(o[0] in set(n[:s]) for o, n, s in zip(other, near, size))


def test_all_pairs_within_three_bits_meet():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    y = x.copy()
    for k in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)

    def sides(prints):
        keys, row = golay.listed(prints)
        out = [(set(), set()) for _ in prints]
        for k, r in zip(keys, row):
            out[r][k & 1].add(int(k) >> 1)
        return out

    assert all(a[0] & b[1] and a[1] & b[0] for a, b in zip(sides(x), sides(y)))


def test_forest_connects_what_is_connected():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)]))
    a, b = golay.forest(points)
    assert (np.bitwise_count(a ^ b) <= 3).all()
    want = classes(points.tolist())
    assert len(a) == len(points) - len(set(want.values()))
    assert all(want[int(x)] == want[int(y)] for x, y in zip(a, b))


@pytest.mark.parametrize("block", [4096, 8])
def test_links_of_dense_clusters_equal_brute_force(spark, block):
    rng = np.random.default_rng(4)
    center = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    prints = {int(c) for c in center} | {0, 1, 7, 15, 1 << 63}
    for c in center:
        for _ in range(60):
            v = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 7)):
                v ^= 1 << int(b)
            prints.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in prints]
    df = spark.createDataFrame([(v,) for v in signed], "print long")
    found = [(r.a, r.b) for r in golay.links(df, block).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 for a, b in found)
    parent = {v: v for v in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[find(a)] = find(b)
    want = classes(prints)
    groups = {}
    for v in signed:
        groups.setdefault(find(v), set()).add(want[v % (1 << 64)])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_documents_equal_brute_force(spark):
    rows = documents(spark)
    assert run(spark, rows)[1] == expected(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Ab"), (5, "aB"), (6, "a b"), (7, "ÄB c"), (8, "äb c"), (9, long), (10, long + " end"), (None, "only null"), (None, None), (11, "x y z"), (11, "x y z"), (12, "a\x00b c d e")]
    assert run(spark, rows)[1] == expected(rows)
    assert run(spark, [])[1] == []


def test_other_columns_stay_and_results_replace(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", 5), (2, "a b c d", None, 6)], "doc_id long, text string, fingerprint string, print int")
    out = golay.with_components(golay.fingerprinted(df))
    assert sorted(out.columns) == ["component_id", "doc_id", "fingerprint", "text"]
    assert {(r.doc_id, r.component_id, r.text) for r in out.collect()} == {(1, 1, "a b c d"), (2, 1, "a b c d")}
