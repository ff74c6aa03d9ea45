"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

Words are runs of other characters than ASCII blanks, A-Z in lower case; a shingle is three words, a text of fewer words is one. A bit of a
text's fingerprint is set if it is set in more than half of its shingles' XXH64 hashes. Fingerprints link at ``RADIUS`` differing bits or fewer.

1. One row stands for all equal fingerprints.
2. The 64 bits are cut into three segments, each a word of 23 bits (zeros before it). The Golay code is perfect: one code word lies within three
   bits of any word, and a word has at most five more code words at four bits. A segment's near keys are the 12-bit indices of all of these, its
   own key is the nearest's. If two words differ in one bit or none, the own key of each is a near key of the other.
3. Three differing bits leave two of the three segments with one difference at most. So for each pair of segments a fingerprint is listed on the
   left under (own key, near keys) and on the right under (near keys, own key): two linked fingerprints meet, left and right, under the pair of
   their own keys. That makes about 32 rows of two longs for each fingerprint.
4. Those that meet are verified by their differing bits. Of larger groups only a spanning forest of the links leaves a task, never all pairs.

A key under which more than ``BLOCK`` rows meet is cut into parts by the fingerprint's hash, and every two parts are compared in a task of their own, so
no key is one task's. Such a group of m fingerprints costs m * m / 2 comparisons of two longs, whole and exact, at about a nanosecond each.

Null, empty and blank texts have the fingerprint zero, which links like any other. Copies share a fingerprint and so a component. A component is
named by the least key of its rows, null only if all are null. An empty table gives an empty one. Other columns stay; columns named like a
result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.common import extend, longs, table, written
from sessionloom.llm.graph import components

SHINGLE, RADIUS = 3, 3
BLOCK = 4096
SMALL = 64  # pairs of a group that are looked at all at once
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # shift and width
#: A generator polynomial of the binary Golay code, and its numbers of bits and of check bits.
GENERATOR, BITS, CHECKS = 0b110001110101, 23, 11


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of each byte of a word, and per remainder the error patterns of up to four bits (the lightest first) and how many there are."""
    single = np.array([_remainder(1 << b) for b in range(24)], np.int64)  # bit 23 is never set
    byte = np.arange(256)
    parts = np.zeros((3, 256), np.int64)
    for k in range(3):
        for b in range(8):
            parts[k] ^= np.where(byte >> b & 1, single[8 * k + b], 0)
    patterns = np.zeros((1 << CHECKS, 6), np.int64)
    sizes = np.zeros(1 << CHECKS, np.int64)
    for weight in range(5):
        for places in combinations(range(BITS), weight):
            remainder = int(np.bitwise_xor.reduce(single[list(places)])) if places else 0
            patterns[remainder, sizes[remainder]] = sum(1 << p for p in places)
            sizes[remainder] += 1
    return parts, patterns, sizes


_PARTS, _PATTERNS, _SIZES = _tables()


def near_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the code words within four bits of each 23-bit word, six columns with the nearest first, and how many of them count."""
    remainder = _PARTS[0][words & 255] ^ _PARTS[1][words >> 8 & 255] ^ _PARTS[2][words >> 16]
    return (words[:, None] ^ _PATTERNS[remainder]) >> CHECKS, _SIZES[remainder]


def listed(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, row)``: all keys of each fingerprint; bit 0 of a key is its side, so that keys without it sort together."""
    found = [near_keys((prints >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)) for shift, width in SEGMENTS]
    columns = np.arange(6)
    keys, rows = [], []
    for n, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        (near_i, size_i), (near_j, size_j) = found[i], found[j]
        own_i, own_j = near_i[:, :1], near_j[:, :1]
        for side, values, size in ((0, own_i << 12 | near_j, size_j), (1, near_i << 12 | own_j, size_i)):
            row, at = np.nonzero(columns < size[:, None])
            keys.append((values[row, at] | n << 24) << 1 | side)
            rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def forest(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among different fingerprints, one less than there are points in each component."""
    a, b = [points[:0]], [points[:0]]
    left = points
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            some = max(1, (1 << 20) // len(left))
            near = np.bitwise_count(front[:some, None] ^ left[None]) <= RADIUS
            hit = near.any(0)
            a.append(left[hit])
            b.append(front[:some][near[:, hit].argmax(0)])
            front, left = np.r_[front[some:], left[hit]], left[~hit]
    return np.concatenate(a), np.concatenate(b)


def _met(keys: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within whole groups of rows ordered by key, the left ones of each group first."""
    group, right = keys >> 1, keys & 1
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    rights = np.add.reduceat(right, first)
    lefts = size - rights
    pairs = lefts * rights
    small = np.flatnonzero((pairs > 1) & (pairs <= SMALL))  # a lone pair is a fingerprint with itself, or its group is too small to link
    small = np.r_[small, np.flatnonzero((pairs == 1) & (prints[first] != prints[np.minimum(first + 1, len(prints) - 1)]))]
    for k in range(0, len(small), 1 << 16):
        some = small[k : k + (1 << 16)]
        n = pairs[some]
        which = np.repeat(np.arange(len(some)), n)
        p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start, many = first[some][which], rights[some][which]
        x, y = prints[start + p // many], prints[start + lefts[some][which] + p % many]
        near = (np.bitwise_count(x ^ y) <= RADIUS) & (x != y)
        yield x[near], y[near]
    for g in np.flatnonzero(pairs > SMALL):
        yield forest(np.unique(prints[first[g] : first[g] + size[g]]))


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([longs(a.view(np.int64)), longs(b.view(np.int64))], names=["a", "b"])


def _compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.r_[keys, batch.column(0).to_numpy()]
        prints = np.r_[prints, batch.column(1).to_numpy().view(np.uint64)]
        if len(keys) < 1 << 16:
            continue
        whole = int(np.searchsorted(keys, keys[-1] >> 1 << 1))  # the last group may go on
        if whole:
            yield from (_links(*x) for x in _met(keys[:whole], prints[:whole]))
            keys, prints = keys[whole:], prints[whole:]
    if len(keys):
        yield from (_links(*x) for x in _met(keys, prints))


def _compare_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x, y in zip(batch.column(0), batch.column(1)):
            points = np.unique(np.r_[x.values.to_numpy(), y.values.to_numpy()]).view(np.uint64)
            yield _links(*forest(points))


def _list_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for k in range(0, len(prints), 10_000):
            keys, row = listed(prints[k : k + 10_000])
            yield pa.RecordBatch.from_arrays([longs(keys), longs(prints[k : k + 10_000][row].view(np.int64))], names=["key", "print"])


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: links between fingerprints (column ``print``, no repeats) that connect all those within ``RADIUS`` bits."""
    keys = prints.select("print").mapInArrow(_list_keys, "key long, print long").withColumn("group", F.shiftright("key", 1))
    hot = written(keys.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > block), "hot-keys")
    cold = keys.join(hot, "group", "left_anti").repartition("group").sortWithinPartitions("key")
    found = cold.select("key", "print").mapInArrow(_compare_groups, "a long, b long")
    if not hot.limit(1).count():
        return found
    part = F.pmod(F.xxhash64("print"), F.ceil(F.col("n") / block)).alias("part")
    parts = keys.join(hot, "group").select("group", "print", part).groupBy("group", "part").agg(F.collect_set("print").alias("prints"))
    parts = written(parts, "hot-parts")
    two = parts.join(parts.select("group", F.col("part").alias("other"), F.col("prints").alias("more")), "group").where("part <= other")
    return found.unionByName(two.select("prints", "more").mapInArrow(_compare_parts, "a long, b long"))


def _majority(batch: pa.RecordBatch, place: int) -> pa.Array:
    column = batch.column(place)
    offsets = column.offsets.to_numpy().astype(np.int64)
    hashes = column.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    has = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), np.uint64)
    if len(has):
        for b in range(64):
            votes = np.add.reduceat((hashes >> np.uint64(b) & np.uint64(1)).astype(np.int32), offsets[:-1][has], dtype=np.int64)
            out[has] |= (2 * votes > sizes[has]).astype(np.uint64) << np.uint64(b)
    return longs(out.view(np.int64))


def words(text: str) -> Column:
    """Words of a text, A-Z in lower case."""
    folded = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(folded, "[\\x20\\x09-\\x0D]+"), "")


def fingerprinted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``print``, the fingerprint as a long."""
    w = F.col("__words")
    several = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(SHINGLE)])))
    few = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    cut = docs.drop("print").withColumn("__words", words(text))
    hashed = cut.withColumn("__hashes", F.when(F.size(w) >= SHINGLE, several).otherwise(few)).drop("__words")
    place = len(hashed.columns) - 1
    return extend(hashed, [T.StructField("print", T.LongType())], lambda batch: [_majority(batch, place)]).drop("__hashes")


def with_components(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``fingerprinted`` with ``fingerprint`` (16 hex digits) and ``component_id`` in place of ``print``. They are stored once."""
    rows = written(prints.drop("fingerprint", "component_id"), "prints")
    least = written(rows.groupBy("print").agg(F.min(F.col(f"`{key}`")).alias("least")), "distinct-prints")
    roots = components(links(least), "golay").withColumnRenamed("node", "print")
    rooted = least.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("print", "root").join(names, "root").select("print", "component_id")
    kept = [f"`{c}`" for c in rows.columns if c != "print"]
    return rows.join(named, "print").select(*kept, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op13_golay_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_components(fingerprinted(docs).select("doc_id", "print"))
