import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import rtree

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=5, k=5, m=3, shares=(50, 95, 100)):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, lab in ok:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other == lab) for j, w, other in ok if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2])[:k]:
            inside = sorted((t, n) for t, n, same in scored if not same and shares[0] * -s <= shares[2] * -t <= shares[1] * -s)[:m]
            out.extend((i, j, r, n, -s, -t) for r, (t, n) in enumerate(inside, 1))
    return sorted(out)


def run(spark, rows, tile=2048, leaf=128, every=5):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("uid", F.lit("x"))
    found = rtree.hard_negatives(df, F.col("label"), F.col("id") % every == 0, tile=tile, leaf=leaf)
    return sorted(tuple(r) for r in found.collect())


def clustered(seed, n, dim, labels):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim))
    return [(i, [float(x) for x in centers[rng.integers(6)] + 0.2 * rng.normal(size=dim)], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("tile,leaf", [(2048, 128), (40, 4), (7, 3)])
def test_equals_brute_force(spark, tile, leaf):
    rows = clustered(1, 300, 6, 3)
    assert run(spark, rows, tile, leaf) == brute(rows)


def test_ties_and_equal_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [1.0, 0.5] if i % 3 else [float(x) for x in rng.integers(-2, 3, 2) / 2], int(rng.integers(3))) for i in rng.permutation(240)]
    assert run(spark, rows, 30, 4) == brute(rows)


def test_odd_rows(spark):
    rows = clustered(3, 60, 3, 2) + [(None, [1.0, 1.0, 1.0], 1), (100, None, 1), (105, [1.0, None, 1.0], 0), (110, [float("nan"), 1.0, 1.0], 0), (115, [float("inf"), 1.0, 0.0], 0), (120, [1.0, 1.0, 1.0], None)]
    rows += [(125 + i, [float(i), 1.0], i % 2) for i in range(12)] + [(150 + i, [], i % 2) for i in range(6)]
    assert run(spark, rows, 16, 4) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(5, [1.0], 0), (6, [1.0], 0)]) == []


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(100_000, 200_000, 4)], i % 2) for i in range(40)]
    assert run(spark, rows, 16, 4) == brute(rows)
    assert run(spark, rows + [(1000, [3.0e38, 0.0, 0.0, 0.0], 0)], 16, 4) == brute(rows)


def test_repeated_rows_stay_rows(spark):
    rows = clustered(5, 40, 3, 2)
    twice = rows + rows[1:4]  # no anchor among them
    assert run(spark, twice, 16, 4) == brute(twice)


def test_bounds_hold_and_leaves_are_whole():
    rng = np.random.default_rng(6)
    vectors = rng.integers(-300, 300, (1000, 5))
    order = rtree.tiling(vectors, [3, 0, 1], 16)
    assert sorted(order) == list(range(1000))
    tree = rtree.Tree(vectors[order].astype(float), 16)
    anchors = rng.integers(-300, 300, (20, 5)).astype(float)
    scores = anchors @ tree.vectors.T
    span = 16
    for low, high in tree.bounds(anchors):
        for node in range(low.shape[1]):
            mine = scores[:, node * span : (node + 1) * span]
            assert (low[:, node] <= mine.min(1)).all() and (mine.max(1) <= high[:, node]).all()
        span *= rtree.FANOUT


def test_a_box_below_the_kth_is_pruned():
    """Far rows are never scored once near ones fill the window."""
    near, far = np.full((64, 2), 10), np.full((640, 2), -10)
    tree = rtree.Tree(np.r_[near, far].astype(float), 16)
    anchor = np.array([[1.0, 1.0]])
    seen = []

    class Spy(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ other

    bounds = tree.bounds(anchor)
    tree.vectors = tree.vectors.view(Spy)
    found = list(rtree._search(tree, 0, bounds, anchor[0], np.ones(704, bool), np.arange(704), [(-1000, 1000)], [None], 3))
    assert [f[1] for f in found] == [20, 20, 20] and {f[2] for f in found} == {0, 1, 2} and len(seen) == 4
