"""Substring dedup over windows of words by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket (see ``repeats``). A bucket sorts the windows of
its distinct strings by doubling ranks: words, pairs of words, pairs of pairs and so on are numbered in sorted order until a number stands for
a whole window. Windows with equal numbers are counted, with the multiplicity of their strings.

Words are runs of other characters than the ASCII blanks, compared as they are. Null texts have no words; texts shorter than a window lose
nothing. Rows that repeat are copies of each other, and a text of a window or more that occurs twice is removed whole. Null ids are kept, extra
columns ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm.common import longs, mix, runs_of_words, slices, span_hashes, strings, table, utf8, words
from sessionloom.llm.repeats import HASHED_BYTES, Units, distinct_packs, removed, runs, with_repeats

WINDOW, GRAM = 35, 5


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(data, offsets)
    out = np.zeros(len(starts), np.uint64)
    hashes, at = runs_of_words(span_hashes(data, starts, ends), first, GRAM)
    out[at] = hashes
    return out, first


def _pack(raw: bytes):
    found = raw.split()  # the same blanks
    return lambda a, b: b" ".join(found[a:b])


def _prints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    out = np.zeros((2, len(starts)), np.uint64)
    for k, salt in enumerate((0, 0x5851F42D4C957F2D)):
        found, at = runs_of_words(mix(hashes ^ np.uint64(salt)), first, WINDOW)
        out[k, at] = found
    return out[0], out[1]


def _doubled(ranks: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.unique(ranks.astype(np.uint64) << np.uint64(32) | other.astype(np.uint64), return_inverse=True)[1]


def window_ranks(ids: np.ndarray, window: int) -> np.ndarray:
    """A number for the ``window`` ids that begin at each place: equal numbers, equal ids. The last places are left out."""
    ranks, size = np.unique(ids, return_inverse=True)[1], 1
    while 2 * size <= window:
        ranks, size = _doubled(ranks[:-size], ranks[size:]), 2 * size
    rest = window - size
    return _doubled(ranks[: len(ranks) - rest], ranks[rest:]) if rest else ranks


def _bucket(packs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeats as (row of the table, first word, end)."""
    first, which, n = distinct_packs(packs)
    lo, hi = packs.column("lo").to_numpy(), packs.column("hi").to_numpy()
    hashes = packs.column("hash").to_numpy()
    several = np.flatnonzero(np.bincount(np.unique(hashes[first], return_inverse=True)[1])[np.unique(hashes[first], return_inverse=True)[1]] > 1)
    covered: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if len(several):  # buckets with different strings: count their windows
        data, offsets = utf8(packs.column("payload").combine_chunks().take(pa.array(first[several])))
        starts, ends, at = words(data, offsets)
        parts = [(slice(at[i], at[j]), offsets[i], offsets[j]) for i, j in slices(offsets, HASHED_BYTES)]
        ids = np.concatenate([span_hashes(data[a:b], starts[k] - a, ends[k] - a) for k, a, b in parts])
        counts = np.diff(at) - WINDOW + 1
        owner = np.repeat(np.arange(len(several)), counts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        ranks = window_ranks(ids, WINDOW)[at[owner] + place]
        hit = np.bincount(ranks, weights=n[several][owner])[ranks] > 1
        who, a, b = runs(hit, owner, place)
        bounds = np.searchsorted(who, np.arange(len(several) + 1))
        covered = {int(several[k]): (a[bounds[k] : bounds[k + 1]], b[bounds[k] : bounds[k + 1]]) for k in range(len(several))}
    rows, begin, end = [], [], []
    for row, kind in enumerate(which.tolist()):
        if n[kind] > 1:
            rows.append(row)
            begin.append(lo[row])
            end.append(hi[row] + WINDOW)
        elif kind in covered:
            for a, b in zip(*covered[kind]):
                rows.append(row)
                begin.append(lo[row] + a)
                end.append(lo[row] + b + WINDOW)
    return np.array(rows, np.int64), np.array(begin, np.int64), np.array(end, np.int64)


UNITS = Units(WINDOW, GRAM, _grams, _pack, _prints, _bucket)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        data, offsets = utf8(batch.column("text"))
        for i, (spans, copied) in enumerate(zip(batch.column("repeats").to_pylist(), batch.column("copied").to_pylist())):
            found = data[offsets[i] : offsets[i + 1]].tobytes().split()
            n, gone = len(found), 0
            for a, b in reversed(removed(n, spans, copied, WINDOW)):
                gone += b - a
                del found[a:b]
            text = b" ".join(found)
            for column, value in zip(out, (n, gone, hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace"))):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), longs(out[0]), longs(out[1]), strings(out[2]), strings(out[3])], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)``: each text without the words that a repeated window covers."""
    slim = docs.selectExpr(f"`{key}` as doc_id", f"cast(`{text}` as string) as text")
    found = with_repeats(slim, UNITS).select("doc_id", "text", "copied", "repeats")
    return found.mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text that windows of 35 words which occur elsewhere leave."""
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, w, unnest(range(1, len(w) - 33)) AS s FROM d),
win AS (SELECT rid, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM s),
dup AS (SELECT rid, s FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
cov AS (SELECT DISTINCT rid, unnest(range(s, s + 35)) AS i FROM dup),
gone AS (SELECT rid, count(*) AS n FROM cov GROUP BY rid),
word AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN cov USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)
"""
