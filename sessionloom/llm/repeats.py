"""Search for windows of a fixed size that occur twice, common to the substring operators.

A window is ``window`` units in a row (bytes or words) of one text. Its anchor is the leftmost gram of ``gram`` units with the smallest hash, so
equal windows have equal anchors at equal places. Consecutive windows with the same anchor form a super-window.

1. Texts are told apart by a 128-bit digest. All windows of a text that occurs twice are repeats; one copy stands for the others below.
2. The anchors of all texts are listed, one for many windows, and counted. Windows of an anchor that occurs once cannot repeat and are
   dropped. This is what keeps packed copies of unique text out of the shuffle.
3. The other super-windows travel, packed, to the bucket of their anchor, where the operator compares them. An anchor with more than ``HOT``
   super-windows has no bucket: its windows are counted by 128-bit hashes with map-side combination, however many there are.
4. The repeats of a text are put together and applied in one pass over the documents.

The texts are shuffled once by digest for packing and for the last pass; Spark splits a hot digest there. Nothing is gathered per source or
per group of copies, and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import by_slice, digest, longs, mix, span_hashes, written

HOT = 1 << 17  # some 32 MB packed
CHUNK_BYTES = 6 << 20
HASHED_BYTES = 1 << 20  # packed bytes hashed at once: some forty bytes each
_PLACE = np.uint64((1 << 28) - 1)


@dataclass(frozen=True)
class Units:
    """How a text is cut. ``grams``: hashes of the grams that begin at each unit, and the first unit of each row. ``pack``: a super-window's
    units as bytes, from the row's bytes and the range of units. ``prints``: two hashes of the windows that begin at each unit."""

    window: int
    gram: int
    grams: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    pack: Callable[[bytes], Callable[[int, int], bytes]]
    prints: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    bucket: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def super_windows(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first window, last window and anchor place of each super-window, in units of the slice."""
    n = len(hashes)
    if n < window:
        return (np.zeros(0, np.int64),) * 4
    keyed = (hashes & ~_PLACE) | np.arange(n, dtype=np.uint64)
    anchor = (sliding_min(keyed, window - gram + 1)[: n - window + 1] & _PLACE).astype(np.int64)
    ends = np.repeat(first[1:], np.diff(first))
    starts = np.flatnonzero(ends[: len(anchor)] - np.arange(len(anchor)) >= window)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    new = np.r_[True, (anchor[starts[1:]] != anchor[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)]
    lo = starts[new]
    hi = starts[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]]
    return np.searchsorted(first, lo, "right") - 1, lo, hi, anchor[lo]


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values, kind))


def anchors(texts: DataFrame, units: Units) -> DataFrame:
    """``(mark, hash[], times[])``: the distinct anchors of every text that has a window, and how many super-windows each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in by_slice(batch.column(1)):
                hashes, first = units.grams(data, offsets)
                row, _, _, at = super_windows(hashes, first, units.window, units.gram)
                found = hashes[at]
                order = np.lexsort((found, row))
                row, found = row[order], found[order]
                new = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]) | (row[1:] != row[:-1])]) if len(row) else row
                times = np.diff(np.r_[new, len(row)])
                counts = np.bincount(row[new], minlength=j - i)
                has = np.flatnonzero(counts)
                marks = batch.column(0)[i:j].take(pa.array(has))
                lists = _lists(counts[has], found[new].astype(np.int64), pa.int64()), _lists(counts[has], times, pa.int32())
                yield pa.RecordBatch.from_arrays([marks, *lists], names=["mark", "hash", "times"])

    return texts.mapInArrow(run, "mark long, hash array<long>, times array<int>")


def _chosen(units: Units, data: np.ndarray, offsets: np.ndarray, wanted: pa.Array):
    """Super-windows of the texts whose anchors are in their row's list: row, hash, first window, last window, anchor; and each row's first unit."""
    hashes, first = units.grams(data, offsets)
    row, lo, hi, at = super_windows(hashes, first, units.window, units.gram)
    lists, places = wanted.flatten().to_numpy().astype(np.uint64), np.r_[0, np.cumsum(pc.list_value_length(wanted).to_numpy())]
    bounds = np.searchsorted(row, np.arange(len(places)))
    keep = np.concatenate([np.isin(hashes[at[a:b]], lists[c:d]) for a, b, c, d in zip(bounds, bounds[1:], places, places[1:])])
    return row[keep], hashes[at[keep]], lo[keep], hi[keep], at[keep], first


def _packs(units: Units):
    """From (key, text, anchors) to a row per super-window with its units packed; places are units of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            for i, j, data, offsets in by_slice(batch.column("text")):
                row, hashes, lo, hi, at, first = _chosen(units, data, offsets, batch.column("hashes")[i:j])
                lo, hi, at = lo - first[row], hi - first[row], at - first[row]
                payloads, bounds = [], np.searchsorted(row, np.arange(j - i + 1))
                for r in np.unique(row).tolist():
                    cut = units.pack(data[offsets[r] : offsets[r + 1]].tobytes())
                    mine = slice(bounds[r], bounds[r + 1])
                    payloads += [cut(a, b + units.window) for a, b in zip(lo[mine].tolist(), hi[mine].tolist())]
                arrays = [longs(hashes.astype(np.int64)), keys[i:j].take(pa.array(row)), *(pa.array(x, pa.int32()) for x in (lo, hi, at)), pa.array(payloads, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["hash", "key", "lo", "hi", "at", "payload"])

    return run


def _hot_prints(units: Units):
    """From (key, text, anchors) to the hashes of the distinct windows of those anchors, each with its places in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in by_slice(batch.column("text")):
                row, _, lo, hi, _, first = _chosen(units, data, offsets, batch.column("hashes")[i:j])
                counts = hi - lo + 1
                at = np.repeat(lo, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                owner = np.repeat(row, counts)
                a, b = units.prints(data, offsets)
                a, b, place = a[at], b[at], at - first[owner]
                order = np.lexsort((place, b, a, owner))
                a, b, owner, place = a[order], b[order], owner[order], place[order]
                new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (owner[1:] != owner[:-1])]) if len(owner) else owner
                keys = batch.column("key")[i:j].take(pa.array(owner[new]))
                places = _lists(np.diff(np.r_[new, len(owner)]), place, pa.int32())
                yield pa.RecordBatch.from_arrays([keys, longs(a[new].astype(np.int64)), longs(b[new].astype(np.int64)), places], names=["key", "w1", "w2", "at"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ``CHUNK_BYTES`` that hold all rows of each of their hashes; the input is in order of the hash."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            table = pa.Table.from_batches(held)
            hashes = table.column("hash").to_numpy()
            cut = int(np.searchsorted(hashes, hashes[-1]))  # the last hash may go on
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held, size = rest.to_batches(), rest.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _bucket_repeats(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            row, start, end = units.bucket(table)
            keys = table.column("key").combine_chunks().take(pa.array(row))
            yield pa.RecordBatch.from_arrays([keys, pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["key", "a", "b"])

    return run


def distinct_packs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per distinct super-window, which of them each row is, and how many rows are like it."""
    payload = table.column("payload").combine_chunks()
    prints = np.concatenate([np.zeros(0, np.uint64), *(span_hashes(data, offsets[:-1], offsets[1:]) for _, _, data, offsets in by_slice(payload, HASHED_BYTES))])
    hashes = table.column("hash").to_numpy().astype(np.uint64)
    both = mix(hashes) + prints
    _, first, which, n = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    return first, which, n


def runs(hit: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and last place of runs of hits at consecutive places of one owner; input in that order."""
    owner, place = owner[hit], place[hit]
    if not len(owner):
        return owner, place, place
    new = np.r_[True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(owner) - 1]
    return owner[new], place[new], place[last]


def with_repeats(docs: DataFrame, units: Units) -> DataFrame:
    """``docs(doc_id, text)`` with ``key``, ``copied`` (the text occurs twice) and ``repeats``, ``[a, b)`` in units, null if there are none."""
    texts = docs.select("doc_id", "text", digest().alias("key"))
    kinds = texts.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    # A mark of 64 bits will do for a text here: two texts under one mark would only be searched for each other's anchors too.
    listed = written(anchors(texts.select(F.xxhash64("key").alias("mark"), "text"), units), "anchors")
    counted = listed.selectExpr("inline(arrays_zip(hash, times))").groupBy("hash").agg(F.sum("times").alias("n")).where("n > 1")
    counts = written(counted, "anchor-counts")  # a table, so that Spark can split an anchor of very many texts in the join
    met = listed.select("mark", F.explode("hash").alias("hash")).join(counts, "hash").withColumn("hot", F.col("n") > HOT)
    one_each = kinds.select(F.col("key").alias("k"), "first_id", F.xxhash64("key").alias("mark"))

    def apart(hot: bool) -> DataFrame:
        wanted = met.where(F.col("hot") == hot).groupBy("mark").agg(F.collect_set("hash").alias("hashes"))  # the anchors of one text
        mine = wanted.join(one_each, "mark")
        return texts.join(mine, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("key", "text", "hashes")

    packs = apart(False).mapInArrow(_packs(units), "hash long, key binary, lo int, hi int, at int, payload binary")
    cold = packs.repartition("hash").sortWithinPartitions("hash").mapInArrow(_bucket_repeats(units), "key binary, a int, b int")
    prints = apart(True).mapInArrow(_hot_prints(units), "key binary, w1 long, w2 long, at array<int>")
    twice = prints.groupBy("w1", "w2").agg(F.sum(F.size("at")).alias("n")).where("n > 1").drop("n")
    warm = prints.join(twice, ["w1", "w2"]).select("key", F.transform("at", lambda a: F.struct(a.alias("a"), (a + units.window).alias("b"))).alias("spans"))
    copied = kinds.where("copies > 1").select("key", F.array().cast("array<struct<a:int,b:int>>").alias("spans"), F.lit(True).alias("copied"))
    cold = cold.select("key", F.array(F.struct("a", "b")).alias("spans"))
    found = cold.unionByName(warm).withColumn("copied", F.lit(False)).unionByName(copied)
    spans = F.flatten(F.collect_list("spans")).alias("repeats")
    per_text = found.groupBy("key").agg(spans, F.max("copied").alias("copied"))
    return texts.join(per_text, "key", "left")


def removed(length: int, spans: list[dict] | None, copied: bool | None, window: int) -> list[tuple[int, int]]:
    """The maximal runs of units to remove from a text."""
    if copied and length >= window:
        return [(0, length)]
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
