"""Parent chains against a walk along the parents."""

import random

from sessionloom.operators import threads

SCHEMA = "s string, id string, parent string"


def walk(rows):
    parent = {}
    for s, i, p in rows:
        if i is not None:
            known = parent.get((s, i))
            parent[s, i] = p if (s, i) not in parent or known is None else known if p is None else min(known, p)
    out = []
    for s, i in parent:
        at, depth, seen = i, 0, set()
        while at not in seen and parent[s, at] is not None and (s, parent[s, at]) in parent:
            seen.add(at)
            at, depth = parent[s, at], depth + 1
        if at in seen:
            out.append((s, i, None, None, "cyclic"))
        else:
            out.append((s, i, at, depth, "rooted" if parent[s, at] is None else "orphaned"))
    return sorted(out, key=str)


def run(spark, rows):
    return sorted((tuple(r) for r in threads.parent_chains(spark.createDataFrame(rows, SCHEMA), "s", "id", "parent").collect()), key=str)


def test_random_forests_with_breaks(spark):
    rng = random.Random(1)
    rows = []
    for s in ("a", "b", None):
        for i in range(120):
            p = rng.choice([None, "gone", f"n{rng.randrange(120)}", f"n{max(0, i - 1)}", f"n{max(0, i - 1)}", f"n{i}"])
            rows.append((s, f"n{i}", p if i else None))
    assert run(spark, rows) == walk(rows)


def test_long_chain_cycles_and_odd_rows(spark):
    rows = [("x", f"k{i}", f"k{i - 1}" if i else None) for i in range(300)]
    rows += [("x", "c0", "c2"), ("x", "c1", "c0"), ("x", "c2", "c1"), ("x", "tail", "c1"), ("x", "self", "self"), ("y", "k5", "k4"), ("x", None, "k1"), ("x", "k7", "k6")]
    got = run(spark, rows)
    assert got == walk(rows)
    assert ("x", "k299", "k0", 299, "rooted") in got and ("y", "k5", "k5", 0, "orphaned") in got
    assert run(spark, []) == []
