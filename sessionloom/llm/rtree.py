"""Hard-negative mining with a sort-tile-recursive R-tree: exact best inner products within windows that follow from each anchor's positives.

Vectors become integers, floor(256 * x) of each component. The rows that score highest with an anchor and have its label are its positives; a
negative is a row of another label whose score lies between two shares of a positive's score.

1. Packing. All rows are sorted by range along the coordinate of the largest variance and cut into tiles of ``TILE`` rows (more if there would be too many
   tiles); within a tile, the next coordinates tile it on, down to leaves of ``LEAF`` neighbouring rows. Nodes above hold ``FANOUT`` children each and
   a minimum bounding box; a directory has the box of every tile.
2. An inner product with any row in a box lies between the sums, over coordinates, of the least and of the largest product with the box's ends.
   A best-first queue of boxes gives the most promising first. A box outside of all score windows, or strictly below the k-th score found in them, is pruned;
   a box that equals it is not, as a smaller id may win the tie.
3. Anchors first search the tile they lie in, which gives each a k-th score; then the tiles that the directory cannot exclude. Anchors go to a
   tile in packs, by a join on the tile's number; what leaves a task is at most k rows per anchor and window. So every anchor is held against all rows, in
   blocks, and a window of rows per anchor picks the best.

The directory is the only thing that is broadcast: ``DIRECTORY`` coordinates at most. A hot label or many equal vectors make no hot task: tiles
are cut by position in the sort, whatever lies in them.

No part take rows with a null id, a null label, a null vector, a null or non-finite component, or components so large that inner products could
pass 2^55. Vectors meet only those of their own length; an empty one scores 0 with its like. Rows that repeat are rows of their own, but a row of the
anchor's id is neither its positive nor its negative. Ties go to the smaller id. An empty table, or one of a single label, gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import longs, ranked, table, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
SHARES = (50, 95, 100)
TILE, LEAF, FANOUT = 2048, 128, 8
DIRECTORY = 1 << 17
AXES = 4
LARGEST = 1 << 55
_WIDE = 1 << 62

_ANCHOR = "struct<uid:bigint,id:bigint,label:bigint,vec:array<int>,lo:array<bigint>,hi:array<bigint>,kth:array<bigint>>"
_FOUND = "uid long, window int, score long, id long, other long"


def integer_vectors(rows: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """``(id, label, vec, dim)`` of the rows that take part."""
    x = F.transform(F.col(f"`{vector}`"), lambda v: F.floor(v.cast("double") * SCALE))
    finite = F.forall(F.col(f"`{vector}`"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    usable = rows.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & finite)
    made = usable.select(F.col(f"`{key}`").cast("long").alias("id"), label.cast("long").alias("label"), x.alias("vec"), F.size(F.col(f"`{vector}`")).alias("dim"))
    largest = F.coalesce(F.array_max(F.transform("vec", lambda v: F.abs(v.cast("double")))), F.lit(0.0))
    fits = (largest * largest * F.col("dim") < float(LARGEST)) & F.col("label").isNotNull()
    return made.where(fits).withColumn("vec", F.col("vec").cast("array<int>"))


def tiling(vectors: np.ndarray, axes: list[int], leaf: int = LEAF) -> np.ndarray:
    """An order of rows whose runs of ``leaf`` are neighbours: slabs along one axis, each tiled along the next ones."""

    def cut(rows: np.ndarray, left: list[int]) -> list[np.ndarray]:
        rows = rows[np.argsort(vectors[rows, left[0]], kind="stable")] if left else rows
        leaves = -(-len(rows) // leaf)
        if len(left) <= 1 or leaves <= 1:
            return [rows]
        size = leaf * -(-leaves // max(2, round(leaves ** (1 / len(left)))))
        return [part for a in range(0, len(rows), size) for part in cut(rows[a : a + size], left[1:])]

    return np.concatenate(cut(np.arange(len(vectors)), axes)) if len(vectors) else np.zeros(0, np.int64)



def tiles_of(rows: DataFrame, axes: list[int], leaf: int) -> DataFrame:
    """Rows ``(tile, dim, uid, id, label, vec)`` packed: ``(tile, dim, uids, ids, labels, flat, low, high)`` in the order of the leaves."""
    held = rows.groupBy("tile", "dim").agg(F.collect_list(F.struct("uid", "id", "label", "vec")).alias("rows"))  # as many as a tile has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, dim, held in zip(batch.column(0), batch.column(1), batch.column(2)):
                size, of = dim.as_py(), held.values
                n = len(of)
                columns = [of.field(c).to_numpy() for c in ("uid", "id", "label")]
                vectors = of.field("vec").flatten().to_numpy().reshape(n, size)
                start = np.argsort(columns[0], kind="stable")  # rows arrive in any order
                order = start[tiling(vectors[start], [a for a in axes if a < size], leaf)]
                flat = vectors[order]
                out = [tile.as_py(), size, *(c[order] for c in columns), flat.ravel(), flat.min(0), flat.max(0)]
                kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3, *[pa.list_(pa.int32())] * 3]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out, kinds)], names=["tile", "dim", "uids", "ids", "labels", "flat", "low", "high"])

    longs_, ints = "array<bigint>", "array<int>"
    return held.mapInArrow(run, f"tile long, dim int, uids {longs_}, ids {longs_}, labels {longs_}, flat {ints}, low {ints}, high {ints}")


class Tree:
    """The boxes above the rows of a tile. Level 0 are leaves of ``leaf`` rows, each level above holds ``FANOUT`` boxes of the one below in a box."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.leaf, self.vectors = leaf, vectors
        cut = lambda x, size, least: (np.minimum if least else np.maximum).reduceat(x, np.arange(0, len(x), size), axis=0)
        self.levels = [(cut(vectors, leaf, True), cut(vectors, leaf, False))]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            self.levels.append((cut(low, FANOUT, True), cut(high, FANOUT, False)))

    def bounds(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level the least and the largest inner product of each anchor with each box."""
        plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return [(plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T) for low, high in self.levels]


def _search(tree: Tree, at: int, bounds, anchor: np.ndarray, wanted: np.ndarray, ids: np.ndarray, windows: list[tuple[int, int]], kth: list[int | None], k: int):
    """Best-first: ``(window, score, row)`` of the rows that may be among the ``k`` best of each window; ``wanted`` marks the rows that count."""
    kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    least = [low if bound is None else max(low, bound) for (low, _), bound in zip(windows, kth)]  # a score below cannot enter any more
    open_ = [w for w, (low, high) in enumerate(windows) if low <= high]
    if not open_:
        return
    top = len(tree.levels) - 1
    queue = [(-float(bounds[top][1][at, 0]), top, 0)]
    while queue:
        promise, level, node = heapq.heappop(queue)
        high, low = -promise, bounds[level][0][at, node]
        live = [w for w in open_ if high >= least[w] and low <= windows[w][1]]
        if not live:
            if high < min(least[w] for w in open_):
                break  # all that is left promises less
            continue
        if level:
            children = range(node * FANOUT, min((node + 1) * FANOUT, len(tree.levels[level - 1][0])))
            for child in children:
                heapq.heappush(queue, (-float(bounds[level - 1][1][at, child]), level - 1, child))
            continue
        begin = node * tree.leaf
        scores = (tree.vectors[begin : begin + tree.leaf] @ anchor).astype(np.int64)
        counts = wanted[begin : begin + tree.leaf]
        for w in live:
            hit = np.flatnonzero(counts & (scores >= least[w]) & (scores <= windows[w][1]))
            if not len(hit):
                continue
            s, r = np.r_[kept[w][0], scores[hit]], np.r_[kept[w][1], begin + hit]
            if len(s) > k:
                best = np.lexsort((ids[r], -s))[:k]
                s, r = s[best], r[best]
            if len(s) == k:
                least[w] = max(least[w], int(s.min()))
            kept[w] = s, r
    for w, (s, r) in enumerate(kept):
        yield from ((w, int(a), int(b)) for a, b in zip(s, r))


def _search_tiles(k: int, same: bool, leaf: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, *tile, dim in zip(*(batch.column(c) for c in ("pack", "uids", "ids", "labels", "flat", "dim"))):
                uids, ids, labels, flat = (x.values.to_numpy() for x in tile)
                size, asked = dim.as_py(), pack.values
                vectors = flat.reshape(len(ids), size)
                anchors = asked.field("vec").flatten().to_numpy().reshape(len(asked), size)
                most = float(np.abs(vectors).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * size
                kind = np.float64 if most < 1 << 53 else np.int64  # sums of whole numbers are exact in either
                tree, anchors = Tree(vectors.astype(kind), leaf), anchors.astype(kind)
                whose = [asked.field(c).to_numpy() for c in ("uid", "id", "label")]
                low, high, kth = (asked.field(c).to_pylist() for c in ("lo", "hi", "kth"))
                out: list[tuple[int, ...]] = []
                for a in range(0, len(anchors), 256):
                    bounds = tree.bounds(anchors[a : a + 256])
                    for i in range(a, min(a + 256, len(anchors))):
                        wanted = ((labels == whose[2][i]) == same) & (ids != whose[1][i])
                        found = _search(tree, i - a, bounds, anchors[i], wanted, ids, list(zip(low[i], high[i])), kth[i], k)
                        out.extend((int(whose[0][i]), w, s, int(ids[r]), int(uids[r])) for w, s, r in found)
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if j == 1 else pa.int64()) for j, c in enumerate(columns)], names=["uid", "window", "score", "id", "other"])

    return run


def _route(directory: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs of anchors for each tile but their own that may hold a better row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes: dict[int, tuple] = {}
        for tile, dim, low, high in directory:
            boxes.setdefault(dim, []).append((tile, low, high))
        boxes = {d: (np.array([t for t, _, _ in b]), *(np.array([x[j] for x in b], float).reshape(len(b), d) for j in (1, 2))) for d, b in boxes.items()}
        for batch in batches:
            dims, home, asked = batch.column("dim").to_numpy(), batch.column("tile").to_numpy(), batch.column("asked")
            low, high, kth = (asked.field(c).to_pylist() for c in ("lo", "hi", "kth"))
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                anchors = asked.take(pa.array(mine)).field("vec").flatten().to_numpy().reshape(len(mine), d).astype(float)
                tiles, lows, highs = boxes[d]
                plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
                # Floats carry these sums up to a rounding far below the slack.
                least, most = plus @ lows.T + minus @ highs.T, plus @ highs.T + minus @ lows.T
                slack = 1e-9 * (np.abs(least) + np.abs(most)) + 0.5
                may = np.zeros(least.shape, bool)
                for i, row in enumerate(mine):
                    for a, b, bound in zip(low[row], high[row], kth[row]):
                        if a <= b:
                            may[i] |= (most[i] + slack[i] >= (a if bound is None else max(a, bound))) & (least[i] - slack[i] <= b)
                    may[i] &= tiles != home[row]
                for t in np.flatnonzero(may.any(0)):
                    pack = asked.take(pa.array(mine[may[:, t]]))
                    lists = pa.ListArray.from_arrays(pa.array([0, len(pack)], pa.int32()), pack)
                    yield pa.RecordBatch.from_arrays([longs([tiles[t]]), pa.array([d], pa.int32()), lists], names=["tile", "dim", "pack"])

    return run


def best(anchors: DataFrame, tiles: DataFrame, k: int, same: bool, leaf: int = LEAF) -> DataFrame:
    """``(uid, window, place, score, id, other)``: the first ``k`` rows, by score and then id, in each of an anchor's windows ``lo[w]`` to ``hi[w]``.

    ``anchors``: ``(tile, dim, uid, id, label, vec, lo, hi)``; ``same``: of the anchor's label, else of any other.
    """
    directory = [tuple(r) for r in tiles.select("tile", "dim", "low", "high").collect()]  # DIRECTORY coordinates at most
    parts, on = max(1, len(directory)), ["tile", "dim"]
    spread = tiles.select("tile", "dim", "uids", "ids", "labels", "flat").repartition(parts, *on)

    def searched(packs: DataFrame, name: str) -> DataFrame:
        return written(packs.repartition(parts, *on).join(spread, on).mapInArrow(_search_tiles(k, same, leaf), _FOUND), name)

    def asked(kth: Column) -> Column:
        return F.struct("uid", "id", "label", "vec", "lo", "hi", kth.alias("kth")).cast(_ANCHOR)

    nothing = F.transform("lo", lambda _: F.lit(None).cast("long"))
    home = searched(anchors.groupBy(*on).agg(F.collect_list(asked(nothing)).alias("pack")), "home")  # as many as a tile has at most
    full = home.groupBy("uid", "window").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    known = full.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("known"))
    kth = F.transform("lo", lambda _, w: F.get(F.col("bounds"), w))
    bounds = F.transform("lo", lambda _, w: F.try_element_at("known", w))
    bounded = anchors.join(known, "uid", "left").withColumn("bounds", bounds).select("tile", "dim", asked(kth).alias("asked"))
    packs = bounded.mapInArrow(_route(directory), f"tile long, dim int, pack array<{_ANCHOR}>")
    found = home.unionByName(searched(packs, "elsewhere"))
    first = F.row_number().over(Window.partitionBy("uid", "window").orderBy(F.desc("score"), "id", "other"))
    return found.withColumn("place", first).where(F.col("place") <= k)


def pack_tree(vectors: DataFrame, tile: int = TILE, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """``(rows, tiles)``: rows of ``integer_vectors`` with their tile and number, and the packed tiles."""
    vectors = written(vectors, "vectors")
    shape = vectors.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    spread = vectors.select(F.posexplode("vec").alias("axis", "x")).groupBy("axis").agg(F.var_pop("x").alias("v"))
    axes = [r.axis for r in spread.sort(F.desc("v"), "axis").limit(AXES).collect()]
    size = max(tile, -(-shape.n * max(1, shape.dim or 0) // DIRECTORY))
    order = ["dim", *(f"__x{a}" for a in axes[:1]), "id", "label"]
    sorted_ = ranked(vectors.withColumns({f"__x{a}": F.get("vec", F.lit(a)) for a in axes[:1]}), order, "sorted-vectors")
    rows = sorted_.select("dim", F.floor((F.col("rank") - 1) / size).alias("tile"), F.col("rank").alias("uid"), "id", "label", "vec")
    return rows, written(tiles_of(rows, axes[1:] or axes, leaf), "tiles")


def hard_negatives(
    rows: DataFrame, label: Column, anchors: Column, key: str = "vec_id", vector: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, shares: tuple[int, int, int] = SHARES, tile: int = TILE, leaf: int = LEAF,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``; ``anchors`` is a condition on ``id``."""
    held, tiles = pack_tree(integer_vectors(rows, key, vector, label), tile, leaf)
    asked = held.where(anchors)
    wide = {"lo": F.array(F.lit(-_WIDE)), "hi": F.array(F.lit(_WIDE))}
    near = written(best(asked.withColumns(wide), tiles, positives, True, leaf), "positives")
    low, high, of = shares
    floored = lambda x: F.expr(f"(({x}) - pmod({x}, {of}L)) div {of}L")
    near = near.withColumns({"lo": -floored(f"-{low}L * score"), "hi": floored(f"{high}L * score")})
    windows = near.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("place", "lo", "hi"))).alias("w"))  # as many as positives are asked for
    windows = windows.select("uid", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    far = best(asked.join(windows, "uid"), tiles, negatives, False, leaf)
    named = near.select("uid", (F.col("place") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    owners = asked.select("uid", F.col("id").alias("anchor_id"))
    found = far.select("uid", "window", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = found.join(named, ["uid", "window"]).join(owners, "uid")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 50; some labels are shifted first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id AND len(a.e) = len(v.e)),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
