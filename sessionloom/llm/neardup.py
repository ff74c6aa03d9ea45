"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, bands, exact weighted Jaccard similarity.

Words are runs of other characters than ASCII blanks, ASCII case aside; shingles are five words (a text of fewer words is one shingle). A shingle
weighs its occurrences times its inverse document frequency. Document frequencies are counted over all documents in a table of
``DF_BUCKETS`` hash buckets, whose size bounds what is broadcast; as buckets fill in proportion to the corpus, weights do not drift with size.

1. One copy stands for all equal texts.
2. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples; two texts agree in each with the probability of their similarity. At 0.8 one
   of the bands agrees with probability 0.9998. Texts that share a band hang together in a candidate component (links to the
   least member of each band's group, never pairs).
3. Components are cut into blocks of bounded size. A task compares all texts of a block exactly and keeps only each text's class in the block.
   A component of one block is settled by that. A larger one has ``PIVOTS`` texts in all of its blocks, which join the blocks' classes; then
   the texts outside of the component's largest class are compared with all of its texts, block by block. So every pair of a component that
   could still join two classes is compared, and within a class none need be: the classes are the exact components of "similarity >= 0.8".

Of the texts only those in components are shuffled: their 64-bit marks are broadcast to the scan if they are at most ``BROADCAST_KEYS``; else all
texts are shuffled once a round.

Texts without words are in no class but those of their copies. Null texts count as empty. A class is named by the least id among its
documents, null only if no document has an id; rows that repeat are members like others. An empty table gives an empty one, other columns are kept by the filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import by_slice, digest, longs, mix, runs_of_words, span_hashes, table, words, written
from sessionloom.llm.graph import components
from sessionloom.llm.repeats import _lists

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 3
DF_BUCKETS, DF_SLICES = 1 << 20, 128
BLOCK, BLOCK_SHINGLES, PIVOTS = 256, 1 << 20, 16
BROADCAST_KEYS = 1_000_000
SLICE = 1 << 20  # bytes of text looked at at once


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each row, ordered, and the first of each row."""
    starts, ends, first = words(data, offsets)
    hashes, counts = span_hashes(data, starts, ends, fold=True), np.diff(first)
    found, at = runs_of_words(hashes, first, SHINGLE)
    row = np.repeat(np.arange(len(counts)), counts)[at]
    for n in range(1, SHINGLE):
        short, place = runs_of_words(hashes, first, n)
        which = np.repeat(np.arange(len(counts)), counts)[place]
        mine = counts[which] == n
        found, row = np.r_[found, short[mine]], np.r_[row, which[mine]]
    order = np.lexsort((found, row))
    return found[order], np.searchsorted(row[order], np.arange(len(counts) + 1))


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - DF_BUCKETS.bit_length() + 1)).astype(np.int64)


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: hash, row, occurrences."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[new], row[new], np.diff(np.r_[new, len(hashes)])


def _slices(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = total.reshape(DF_SLICES, -1)
    used = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())], names=["slice", "counts"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DF_BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, offsets in by_slice(batch.column(0), SLICE):
            total += np.bincount(bucket(_distinct(*shingles(data, offsets))[0]), minlength=DF_BUCKETS)
    yield from _slices(total)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            held[k] = held.get(k, 0) + np.frombuffer(raw.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["slice", "counts"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """A weight per bucket, from the number of documents that have a shingle in it."""
    kinds = "slice int, counts binary"
    parts = texts.select("text").mapInArrow(_count, kinds).withColumn("salt", F.spark_partition_id() % 16)
    some = parts.repartition("slice", "salt").select("slice", "counts").mapInArrow(_add_up, kinds)
    rows = some.repartition("slice").mapInArrow(_add_up, kinds).collect()  # DF_SLICES rows
    total = np.zeros((DF_SLICES, DF_BUCKETS // DF_SLICES), np.int64)
    for r in rows:
        total[r.slice] += np.frombuffer(r.counts, np.int64)
    n = max(1, texts.count())
    return np.log1p(n / np.maximum(total.ravel(), 1)).astype(np.float32)


_CELLS = 1 << 16
_RNG = np.random.default_rng(2010)
_R = _RNG.gamma(2.0, 1.0, _CELLS).astype(np.float32)
_LOG_C = np.log(_RNG.gamma(2.0, 1.0, _CELLS)).astype(np.float32)
_BETA = _RNG.random(_CELLS).astype(np.float32)
_SALTS = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def signatures(hashes: np.ndarray, rows: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """Band hashes (rows of ``BANDS``) of rows that all have shingles; ``rows`` is ordered and covers 0 to ``count - 1``."""
    starts = np.searchsorted(rows, np.arange(count))
    sizes = np.diff(np.r_[starts, len(rows)])
    log_w = np.log(weights).astype(np.float32)
    samples = np.zeros((BANDS * ROWS, count), np.uint64)
    for k, salt in enumerate(_SALTS):
        cell = (mix(hashes ^ salt) >> np.uint64(48)).astype(np.int64)
        r, beta = _R[cell], _BETA[cell]
        t = np.floor(log_w / r + beta)
        cost = _LOG_C[cell] - r * (t - beta) - r
        least = np.repeat(np.minimum.reduceat(cost, starts), sizes)
        at = np.flatnonzero(cost == least)
        at = at[np.r_[True, rows[at[1:]] != rows[at[:-1]]]]  # a tie goes to the smallest hash
        samples[k] = mix(hashes[at] ^ mix(t[at].astype(np.int64).astype(np.uint64) + salt))
    out = np.zeros((count, BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(count, b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + samples[k])
        out[:, b] = h
    return out


def signed(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """``(key, n, bands)`` of texts ``(key, text)`` that have words."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in by_slice(batch.column(1), SLICE):
                hashes, first = shingles(data, offsets)
                has = np.flatnonzero(np.diff(first))
                if not len(has):
                    continue
                h, row, times = _distinct(hashes, first)
                bands = signatures(h, np.searchsorted(has, row), times * shared.value[bucket(h)], len(has))
                lists = _lists(np.full(len(has), BANDS), bands.ravel().astype(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].take(pa.array(has)), longs(np.diff(first)[has]), lists], names=["key", "n", "bands"])

    return texts.select("key", "text").mapInArrow(run, "key binary, n long, bands array<long>")


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the text (last column) by its ordered shingles."""
    for batch in batches:
        for i, j, data, offsets in by_slice(batch.column(batch.num_columns - 1), SLICE):
            hashes, first = shingles(data, offsets)
            raw = [hashes[a:b].tobytes() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns[:-1]), pa.array(raw, pa.binary())], names=["key", "grp", "payload"])


def similar(vectors: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Matrix of which of some texts, given as ordered shingles, are similar by weighted Jaccard similarity."""
    n = len(vectors)
    h, row = np.concatenate(vectors), np.repeat(np.arange(n), [len(v) for v in vectors])
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(new)
    occurrence = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
    weight = idf[bucket(h)].astype(np.float64)
    total = np.bincount(row, weight, n)
    # The k-th occurrence of a shingle is an element of its own, so that sets do for multisets.
    element, where, times = np.unique(mix(h + occurrence.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), return_inverse=True, return_counts=True)
    shared = times[where] > 1
    columns = np.cumsum(times > 1)[where[shared]] - 1
    row, weight = row[shared], weight[shared]
    both = np.zeros((n, n))
    order = np.argsort(columns, kind="stable")
    columns, row, weight = columns[order], row[order], weight[order]
    for a in range(0, int(columns[-1]) + 1 if len(columns) else 0, 4096):
        i, j = np.searchsorted(columns, (a, a + 4096))
        x = np.zeros((n, int(columns[j - 1]) - a + 1), np.float32)
        x[row[i:j], columns[i:j] - a] = 1
        w = np.zeros(x.shape[1], np.float32)
        w[columns[i:j] - a] = weight[i:j]
        both += (x * w) @ x.T
    union = total[:, None] + total - both
    return both >= SIMILARITY * union - 1e-4 * union


def _least_member(close: np.ndarray) -> np.ndarray:
    """The smallest index that each can reach."""
    label = np.arange(len(close))
    while True:
        new = np.where(close, label, len(close)).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compared(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """Links ``(a, b)`` from texts to the least text of their class within each group, of rows ``(key, grp, payload)``."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def settle(keys: list[bytes], raw: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        order = sorted(range(len(keys)), key=keys.__getitem__)
        order = [k for i, k in enumerate(order) if not i or keys[k] != keys[order[i - 1]]]
        if len(order) > 1:
            label = _least_member(similar([np.frombuffer(raw[k], np.uint64) for k in order], shared.value))
            yield from ((keys[order[i]], keys[order[to]]) for i, to in enumerate(label) if i != to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, raw = None, [], []
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for key, grp, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if grp != group:
                    out.extend(settle(keys, raw))
                    group, keys, raw = grp, [], []
                keys.append(key)
                raw.append(payload)
            yield _links(out)
        yield _links(list(settle(keys, raw)))

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a binary, b binary")


def _links(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _group(*parts: Column | str) -> Column:
    return F.unhex(F.md5(F.concat_ws("/", *[p if isinstance(p, Column) else F.col(p) for p in parts])))


def similar_classes(texts: DataFrame, wanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(node, root)`` of the texts that have a similar one, of ``texts(key, text)``, in which keys may repeat.

    ``wanted`` turns a stored table of keys into rows ``(key, text)``, at least those of the keys and one per key.
    """
    idf = inverse_frequencies(texts)
    bands = written(signed(texts, idf).dropDuplicates(["key"]), "bands")
    members = bands.select("key", F.explode("bands").alias("band"))
    hubs = members.groupBy("band").agg(F.min("key").alias("hub"), F.count("*").alias("size")).where("size > 1").drop("size")
    candidates = components(members.join(hubs, "band").select(F.col("key").alias("a"), F.col("hub").alias("b")), "candidates")

    sized = candidates.join(bands.select(F.col("key").alias("node"), "n"), "node")
    sizes = sized.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    placed = sized.join(sizes.select("root", blocks), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = written(placed.select(F.col("node").alias("key"), "root", "blocks", "block"), "placed")

    # PIVOTS texts of each large component, the least of as many random parts of it, in all of its blocks.
    large = placed.where("blocks > 1")
    parts = large.withColumn("part", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(PIVOTS)))
    pivots = parts.groupBy("root", "part", "blocks").agg(F.min("key").alias("key"))
    everywhere = pivots.select("key", "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = placed.select("key", "root", "block").unionByName(everywhere).select("key", _group(F.hex("root"), "block").alias("grp"))
    links = written(compared(_with_vectors(rows, wanted(placed)), idf), "links")
    if not large.limit(1).count():
        return components(links, "classes")

    # Texts of large components outside of the largest class, against all texts of their component.
    label = components(links, "classes").select(F.col("node").alias("key"), F.col("root").alias("class"))
    labelled = written(large.join(label, "key", "left").withColumn("class", F.coalesce("class", "key")), "labelled")
    per_class = labelled.groupBy("root", "class").agg(F.count("*").alias("n"))
    largest = per_class.groupBy("root").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("all"))
    state = largest.select("root", F.col("top.class").alias("main"), (F.col("all") - F.col("top.n")).alias("open")).where("open > 0")
    open_parts = F.ceil(F.col("open") / BLOCK).cast("int")
    joined = labelled.join(state.withColumn("parts", open_parts), "root")
    all_rows = joined.select("key", "root", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rest = joined.where(F.col("class") != F.col("main")).withColumn("part", F.pmod(F.xxhash64("key", F.lit(9)), F.col("parts")).cast("int"))
    rest = rest.select("key", "root", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = all_rows.unionByName(rest).select("key", _group(F.hex("root"), "block", "part").alias("grp"))
    more = written(compared(_with_vectors(rows, wanted(labelled)), idf), "links")
    return components(links.unionByName(more), "classes")


def _with_vectors(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows ``(key, grp)`` with the shingles of their texts; a text is cut into shingles once, however many groups it is in."""
    groups = rows.groupBy("key").agg(F.collect_set("grp").alias("grps"))
    cut = wanted.join(groups, "key").select("key", "grps", "text")
    vectors = cut.mapInArrow(_vectors, "key binary, grp array<binary>, payload binary")
    return vectors.select("key", F.explode("grp").alias("grp"), "payload")


def _classified(docs: DataFrame, order: str, text: str) -> DataFrame:
    """``docs`` with ``__key``, ``class_id``, ``class_size``, the key of the text that stands for the class, and how many rows have that key and id."""
    keyed = docs.drop("class_id", "class_size").withColumn("__key", digest(text))
    slim = keyed.select(F.col("__key").alias("key"), F.col(f"`{order}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # A missing id comes after all others.
    place = F.struct(F.col("id").isNull().alias("none"), "id")
    copies = slim.groupBy("key", "id").agg(F.count("*").alias("n")).groupBy("key")
    copies = copies.agg(F.min(place)["id"].alias("first_id"), F.sum("n").alias("n"), F.min_by("n", place).alias("twins"))

    def one_each(keys: DataFrame) -> DataFrame:
        near = slim
        if keys.count() <= BROADCAST_KEYS:
            marks = keys.select(F.xxhash64("key").alias("mark"))
            near = slim.join(F.broadcast(marks), F.xxhash64("key") == F.col("mark"), "left_semi")
        return near.join(copies.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("first_id"))).select("key", "text")

    roots = similar_classes(slim.select("key", "text"), one_each).withColumnRenamed("node", "key")
    per_key = copies.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    best = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "key")
    per_class = per_key.groupBy("root").agg(F.min(F.struct(best.alias("best"), "twins")).alias("r"), F.sum("n").alias("class_size"))
    names = per_key.select("key", "root").join(per_class, "root").select(
        F.col("key").alias("__key"), F.col("r.best.first_id").alias("class_id"), "class_size", F.col("r.best.key").alias("__best"), F.col("r.twins").alias("__twins")
    )
    return keyed.join(names, "__key")


def classified(docs: DataFrame, order: str, text: str = "text") -> DataFrame:
    """Add ``class_id`` (least ``order`` of the class) and ``class_size``; ``order`` is any column that can be compared."""
    return _classified(docs, order, text).drop("__key", "__best", "__twins")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, the one with the least id, with its columns as they were; of equal rows one is left."""
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("__row"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("__id"))
    found = _classified(packed, "__id", "text").where((F.col("__key") == F.col("__best")) & F.col("__id").eqNullSafe(F.col("class_id")))
    equal = found.where("__twins > 1").dropDuplicates(["__key"])
    return found.where("__twins = 1").unionByName(equal).select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document; ``kept``: the one that stands for its class."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classified(docs, "doc_id")
    return found.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
