"""Benchmark decontamination: fingerprints of item-sized windows, Hamming blocks, exact verification. DataFrame functions only.

Words are runs of other characters than blanks, in lower case; shingles are five words. A window is as long as some item. It contaminates if
its shingles, weighted by how often they occur, have a Jaccard similarity of ``SIMILARITY`` or more with those of an item of that length.

1. A similarity of 0.8 takes that share of the shingles of the item at the least. So a window is cut at every start, at the length of some item,
   where so many of its shingles occur in items of that length. This leaves out nothing that could pass. Places of shared shingles are gathered
   by the digest of the text, and a second scan cuts the few windows, as slices of the shingle hashes of the text.
2. Every window and item gets a 64-bit SimHash. Items are listed under all values of each of ``BLOCKS`` blocks that differ in at most
   ``RADIUS // BLOCKS`` bits: two fingerprints within ``RADIUS`` bits agree so in one block at least, hence the join on (length, block, value)
   finds all of them. At a similarity of 0.8 two fingerprints differ in 9.7 bits on average, with a deviation of 2.9.
3. Pairs within the radius are verified exactly.

The shingles of the items are broadcast only if the items hold at most ``BROADCAST_WORDS`` words in all, and the starts of windows if there are at
most ``BROADCAST_STARTS``; else Spark shuffles. Texts are shuffled only if a bit of their digest is marked (``marked``): the marks are broadcast and of a
bounded size. Nothing else of the documents is broadcast, and equal fingerprints meet items, never each other.

Null and empty texts are clean; items of fewer than five words are never found. A null key is reported as null. Repeated documents or
items give the same pairs once. Empty tables give no pairs. Other columns are ignored by the search and kept by the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import digest, table, written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS, BLOCKS, BITS = 19, 5, 64
BROADCAST_WORDS = 2_000_000
BROADCAST_STARTS = 500_000
MARK_BITS = 24  # at most 2^18 rows of 64 marks


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")


def shingle(source: Column, at: Column) -> Column:
    """Hash of five words from a place, counted from 0."""
    return F.xxhash64(*[F.get(source, at + k) for k in range(SHINGLE)])


def shingles(source: Column) -> Column:
    """Hashes of all shingles of an array of words, in order."""
    some = F.transform(F.sequence(F.lit(0), F.size(source) - SHINGLE), lambda i: shingle(source, i))
    return F.when(F.size(source) >= SHINGLE, some).otherwise(F.array().cast("array<bigint>"))


def fingerprint(hashes: Column) -> Column:
    """SimHash: the majority of each bit over all shingles."""
    votes = lambda b: F.aggregate(hashes, F.lit(0), lambda n, x: n + F.bit_get(x, b))
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda f, b: F.when(votes(b) * 2 > F.size(hashes), f.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(f))


def numbered(ordered: Column) -> Column:
    """A set that stands for a multiset given in order: each occurrence of a shingle with its number."""
    return F.transform(ordered, lambda x, i: F.xxhash64(x, i - F.array_position(ordered, x)))


def fingerprinted(df: DataFrame, name: str) -> DataFrame:
    """Add ``shingles``, the set form of ``hashes``, and ``print``. Written: what a join or a filter asks for is not made again."""
    ordered = df.withColumn("ordered", F.sort_array("hashes"))
    made = {"uid": F.monotonically_increasing_id(), "shingles": numbered(F.col("ordered")), "print": fingerprint(F.col("hashes"))}
    return written(ordered.withColumns(made).drop("ordered"), name)


def blocks() -> list[tuple[int, int]]:
    """Shift and width of each block."""
    cuts = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def block_values(f: Column, spread: bool) -> Column:
    """``array<struct<block, value>>``; ``spread``: with all values that differ in few bits."""

    def values(k: int, shift: int, width: int) -> Column:
        value = F.shiftrightunsigned(f, shift).bitwiseAND(F.lit((1 << width) - 1))
        near = F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda m: F.bit_count(m) <= RADIUS // BLOCKS) if spread else F.array(F.lit(0))
        return F.transform(near, lambda m: F.struct(F.lit(k).alias("block"), value.bitwiseXOR(m.cast("long")).alias("value")))

    return F.concat(*[values(k, shift, width) for k, (shift, width) in enumerate(blocks())])


def item_table(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, n, hashes, shingles, print)`` of every item of five words or more."""
    found = items.select(F.col(f"`{key}`").alias("item"), words(text).alias("w")).where(F.size("w") >= SHINGLE)
    return fingerprinted(found.select("item", F.size("w").alias("n"), shingles(F.col("w")).alias("hashes")), "items")


def starts(docs: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """``(digest, cuts)``, of ``n`` and ``start``: every window of ``n`` words with enough shingles of items of that length to reach the similarity with one."""
    wanted = items.select("n", F.explode("hashes").alias("hash")).distinct()
    size = items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first().words
    if size <= BROADCAST_WORDS:
        wanted = F.broadcast(wanted)
    placed = docs.select(digest(text).alias("digest"), words(text).alias("w")).select("digest", "w", F.posexplode_outer("w").alias("at", "word"))
    placed = placed.where(F.col("at") <= F.size("w") - SHINGLE).select("digest", "at", shingle(F.col("w"), F.col("at")).alias("hash"))
    met = placed.join(wanted, "hash").select("digest", "n", "at").distinct()
    held = met.groupBy("digest", "n").agg(F.array_sort(F.collect_list("at")).alias("places"))  # as many as the text has words at most
    places, last = F.col("places"), F.col("n") - SHINGLE
    need = F.ceil(F.lit(SIMILARITY) * (last + 1) - F.lit(1e-9)).cast("int")
    full = held.where(F.size(places) >= need).select("digest", "n", F.posexplode("places").alias("i", "first"), F.get(places, F.col("i") + need - 1).alias("enough"))
    near = full.where(F.col("enough") - F.col("first") <= last).withColumn("least", F.greatest(F.lit(0), F.col("enough") - last))
    every = near.select("digest", "n", F.explode(F.sequence("least", "first")).alias("start")).distinct()
    return every.groupBy("digest").agg(F.collect_list(F.struct("n", "start")).alias("cuts"))


def marked(df: DataFrame, digests: DataFrame, by: str) -> DataFrame:
    """Add ``marked``: true for each row whose digest ``by`` is one of some, and for few others."""
    place = F.xxhash64(by).bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    word, bit = F.shiftrightunsigned(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    marks = digests.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("marks"))
    met = df.withColumns({"word": word, "bit": bit}).join(F.broadcast(marks), "word", "left")
    return met.withColumn("marked", F.coalesce(F.bit_get("marks", F.col("bit")), F.lit(0)) == 1).drop("word", "bit", "marks")


def windows(docs: DataFrame, items: DataFrame, key: Column, text: str) -> DataFrame:
    """``(key, n, start, hashes)``: windows of ``n`` words, fewer at an end of the text, that may reach the similarity with an item of that length."""
    wanted = written(starts(docs, items, text), "starts")
    texts = docs.select(key.alias("key"), F.col(f"`{text}`").alias("text"), digest(text).alias("digest"))
    if wanted.agg(F.coalesce(F.sum(F.size("cuts")), F.lit(0)).alias("starts")).first().starts <= BROADCAST_STARTS:
        wanted = F.broadcast(wanted)
    else:
        texts = marked(texts, wanted, "digest").where("marked")
    met = texts.join(wanted, "digest").select("key", words("text").alias("w"), "cuts")
    # A generator may hold all rows of a text at once, so none carries the text's words: each is a slice of hashes made before it.
    cut = met.select("key", shingles(F.col("w")).alias("all"), "cuts").select("key", "all", F.inline("cuts"))
    return cut.select("key", "n", "start", F.slice("all", F.col("start") + 1, F.col("n") - SHINGLE + 1).alias("hashes")).distinct()


def contamination(docs: DataFrame, items: DataFrame, key: Column, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(key, item, similarity)`` of every text that holds an item, with the best window's similarity."""
    table_ = item_table(items, item_key, item_text)
    found = fingerprinted(windows(docs, table_, key, text), "windows")
    # Block rows carry numbers only, and join by a sort: there are some thousand for each item. Shingles come back for the pairs within the radius.
    left = found.select("uid", "n", "print", F.inline(block_values(F.col("print"), False)))
    right = table_.select(F.col("uid").alias("item_uid"), "n", F.col("print").alias("other"), F.inline(block_values(F.col("print"), True)))
    met = left.join(right.hint("merge"), ["n", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= RADIUS)
    theirs = table_.select(F.col("uid").alias("item_uid"), "item", F.col("shingles").alias("theirs"))
    near = met.select("uid", "item_uid").distinct().join(found.select("uid", "key", "shingles"), "uid").join(theirs, "item_uid")
    both = F.size(F.array_intersect("shingles", "theirs"))
    scored = near.withColumn("similarity", both / (F.size("shingles") + F.size("theirs") - both))
    return scored.where(F.col("similarity") >= SIMILARITY).groupBy("key", "item").agg(F.max("similarity").alias("similarity"))


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents without any item, with their columns as they were."""
    held = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("__row"), digest(text).alias("__key"))
    found = written(contamination(docs, items, digest(text), text).select(F.col("key").alias("__key")).distinct(), "found")
    either = marked(held, found, "__key")
    clean = either.where("not marked").unionByName(either.where("marked").join(found, "__key", "left_anti"))
    return clean.select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination(docs, items, F.col("doc_id")).select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "similarity")
