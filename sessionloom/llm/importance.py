"""Importance resampling towards a target: documents whose words look like those of a target text are drawn with higher probability.

Features are runs of consecutive words, counted in ``BUCKETS`` hash buckets over all documents and all target texts. A bucket's gain is the
logarithm of its smoothed share in the target over that in the documents; a document's weight is the mean gain of its features. A weight plus
Gumbel noise that depends on the document's key alone gives the score, and the highest scores are the sample: drawing without replacement.

1. Bucket counts are combined in the tasks that read the texts; at most ``BUCKETS`` rows leave for the driver, whose gains become one array.
   Weights are looked up in that array while the texts are read a second time; no text is shuffled.
2. The k-th score is found by distributed quickselect over the written scores: about ``PIVOTS`` random rows of the interval that still holds the
   k-th key are its pivots, one aggregation counts the rows below, at and between them exactly, and the interval narrows to one part. Keys are
   composite (score, id, ..., number of the stored row), so no two are equal. What reaches the driver is bounded by the number of pivots.
3. Only the winners are sorted, by range, and ranked by the counts of their parts.

Null and empty texts have no features and weight 0. A null key counts as the empty text in the noise and comes after all others in ties. Rows that
repeat are drawn like others; of equal rows any may get the lower rank. An empty table gives an empty one; an empty target leaves the smoothing
alone. Other columns stay; columns named like a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import ranked, table, written

BUCKETS = 10_000
LOW, HIGH = 1, 1
LEAST_WORDS = 20
SHARE = (10, 100)
SEED = 2024
PIVOTS = 32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what is not a word, in lower-cased text.
BETWEEN_WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: str) -> Column:
    folded = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(folded, BETWEEN_WORDS), "")


def feature_buckets(source: Column, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> Column:
    """The bucket of each run of ``low`` to ``high`` words of an array of words."""

    def runs(n: int) -> Column:
        if n == 1:
            return source
        joined = F.transform(F.sequence(F.lit(1), F.size(source) - n + 1), lambda i: F.array_join(F.slice(source, i, n), " "))
        return F.when(F.size(source) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.transform(F.concat(*[runs(n) for n in range(low, high + 1)]), lambda x: (F.crc32(x) % buckets).cast("int"))


def bucket_counts(texts: DataFrame, text: str = "text", low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: how many features of all texts fall into each bucket."""
    cut = texts.select(words(text).alias("w")).select(F.explode(feature_buckets(F.col("w"), low, high, buckets)).alias("bucket"))
    return cut.groupBy("bucket").agg(F.count("*").alias("n"))


def gains(seen: dict[int, int], wanted: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Per bucket: 1000 times the logarithm of the smoothed share in the target over that in the documents, rounded down."""
    s_all, t_all = float(sum(seen.values()) + buckets), float(sum(wanted.values()) + buckets)
    ratio = lambda b: (float(wanted.get(b, 0) + 1) * s_all) / (float(seen.get(b, 0) + 1) * t_all)
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def noise(key: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate that follows from the seed and the key, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def weighted(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Add ``n_words``, ``n_features``, ``weight`` and ``score`` of every document."""
    # ``buckets`` rows each, at most
    seen, wanted = ({r.bucket: r.n for r in bucket_counts(*x, low, high, buckets).collect()} for x in ((docs, text), (target, target_text)))
    # A folded constant: parsed once, then an array that every look-up shares.
    array = F.split(F.lit(",".join(map(str, gains(seen, wanted, buckets)))), ",").cast("array<bigint>")
    total = F.aggregate("__buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(array, b))
    n = F.col("n_features")
    cut = docs.withColumn("__words", words(text)).withColumn("__buckets", feature_buckets(F.col("__words"), low, high, buckets))
    summed = cut.withColumns({"n_words": F.size("__words").cast("long"), "n_features": F.size("__buckets").cast("long"), "__total": total})
    floored = F.when(n > 0, F.expr("(__total - pmod(__total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return summed.withColumn("weight", floored).withColumn("score", F.col("weight") + noise(F.col(f"`{key}`"), seed)).drop("__words", "__buckets", "__total")


def _literal(rows: DataFrame, names: list[str], row) -> Column:
    return F.struct(*[F.lit(row[c]).cast(rows.schema[c].dataType).alias(c) for c in names])


def kth_key(rows: DataFrame, names: list[str], k: int, pivots: int = PIVOTS) -> Column | None:
    """The ``k``-th smallest key (from 1) as a literal struct of the columns ``names``, whose values differ between any two rows.

    ``rows`` should be a stored table: a round reads the key columns twice. ``None`` if there is no such row.
    """
    key = F.struct(*names)
    inside, left, size = rows, k, rows.count()
    if not 0 < k <= size:
        return None
    salt = 0
    while True:
        salt += 1
        chosen = inside.where(F.pmod(F.xxhash64(*names, F.lit(salt)), F.lit(max(1, size // pivots))) == 0).select(*names).limit(4 * pivots)
        found = [(r, _literal(rows, names, r)) for r in chosen.sort(*names).collect()]  # 4 * PIVOTS rows at most
        if not found:
            continue  # no row fell into the draw; the next salt draws anew
        # Part 2 i: between pivots i - 1 and i; part 2 i + 1: pivot i itself.
        part = sum(((key >= p).cast("int") + (key > p).cast("int") for _, p in found), F.lit(0))
        counts = {r.part: r.n for r in inside.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
        for i in range(2 * len(found) + 1):
            size = counts.get(i, 0)
            if left <= size:
                break
            left -= size
        if i % 2:
            return found[i // 2][1]
        # The leading column alone lets the scan skip what is far away.
        if i:
            row, above = found[i // 2 - 1]
            inside = inside.where((F.col(names[0]) >= row[names[0]]) & (key > above))
        if i < 2 * len(found):
            row, below = found[i // 2]
            inside = inside.where((F.col(names[0]) <= row[names[0]]) & (key < below))


def resample(scores: DataFrame, key: str = "doc_id", share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows of ``weighted`` with ``rank``: 1 for the highest score among the drawn, null if not drawn. Drawn is the share of those with enough words."""
    names = ["__score", "__none", "__id", "__weight", "__features", "__row"]
    parts = [-F.col("score"), F.col(f"`{key}`").isNull(), F.col(f"`{key}`"), F.col("weight"), F.col("n_features"), F.monotonically_increasing_id()]
    rows = written(scores.drop("rank").withColumns(dict(zip(names, parts))), "scores")
    able = rows.where(F.col("n_words") >= least_words)
    wanted = share[0] * able.count() // share[1]
    last = kth_key(able.select(*names), names, wanted)
    none = F.lit(None).cast("long").alias("rank")
    kept = [f"`{c}`" for c in scores.columns if c != "rank"]
    if last is None:
        return rows.select(*kept, none)
    won = F.coalesce((F.col("n_words") >= least_words) & (F.struct(*names) <= last), F.lit(False))
    return ranked(rows.where(won), names, "winners").select(*kept, "rank").unionByName(rows.where(~won).select(*kept, none))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw of 10 % towards the benchmark."""
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    scores = weighted(docs, target).select("doc_id", "n_words", "n_features", "weight", "score")
    return resample(scores).select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bit8 AS (
  SELECT list_reduce([i.range, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS entry, i.range AS i
  FROM range(256) AS i),
crc AS (SELECT list(entry ORDER BY i) AS t FROM bit8),
vocabulary AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM b)),
octets AS (
  SELECT word, list_transform(range(octet_length(encode(word))), lambda k: CAST('0x' || substr(hex(encode(word)), 2 * k + 1, 2) AS BIGINT)) AS o
  FROM vocabulary),
bucketed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, o), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket
  FROM octets, crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN bucketed USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN bucketed USING (word) GROUP BY 1),
sizes AS (SELECT (SELECT count(*) FROM dw) AS sa, (SELECT count(*) FROM b) AS ta),
gain AS (
  SELECT word, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(sa + 10000 AS DOUBLE)) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(ta + 10000 AS DOUBLE)))) AS BIGINT) AS g
  FROM bucketed LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sizes),
weights AS (SELECT doc_id, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM dw JOIN gain USING (word) GROUP BY 1),
scored AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000.0 * ln(-ln((CAST('0x' || left(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20),
n AS (SELECT 10 * count(*) // 100 AS k FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank FROM scored LEFT JOIN r USING (doc_id), n
"""
