"""Language identification by cross-parsing entropy.

For each language a bounded sample of labelled text becomes a suffix automaton. A text is parsed against it into longest matches: a phrase ends
where the text leaves the automaton. With n symbols of training and m symbols of text, ``phrases * log2(n) / m`` estimates the bits a symbol
of the text costs; the language with the fewest normalised phrases wins, ties go to the smaller name.

The symbols are the UTF-8 bytes of letters, so every letter of every script counts as itself. The automata are built on the driver from at most
``SAMPLE_ROWS`` rows and ``SAMPLE_SYMBOLS`` letters per language and flattened to transition tables over the bytes of that language. This bounds
what is broadcast: twice as many states as bytes, times 144 at most (the bytes of UTF-8 without upper case, an unknown one and the end mark).
Whole texts are parsed: chunks of ``CHUNK`` bytes of all texts of a batch step through a table together, so a text of any length costs its
length only.

Letters count in lower case, every run of other characters as one gap. The prediction is ``und`` with score 0 for null texts, texts without
letters, or if nothing was learned. Text and labels are the only inputs. A null id is not held out. Repeated rows give repeated results and are
learned from once, an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.common import by_slice, digest, extend, table

SAMPLE_ROWS = 100
SAMPLE_SYMBOLS = 50_000
CHUNK = 256
UNKNOWN = "und"
END = 0xFF  # no byte of UTF-8


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for other characters."""
    found = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        letter = chr(c)
        if letter.isalpha():
            low = letter.lower()
            found[c] = ord(low) if len(low) == 1 else c
    return found


@cache
def _packed() -> np.ndarray:
    """UTF-8 bytes of each code point as one number, the last byte lowest."""
    c = np.arange(0x110000, dtype=np.uint32)
    tail = [(0x80 | (c >> 6 * k) & 0x3F) << 8 * k for k in range(3)]
    two, three, four = (0xC0 | c >> 6) << 8, (0xE0 | c >> 12) << 16, (0xF0 | c >> 18) << 24
    return np.select([c < 0x80, c < 0x800, c < 0x10000], [c, two | tail[0], three | tail[1] | tail[0]], four | tail[2] | tail[1] | tail[0]).astype(np.uint32)


def unpacked(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of packed letters, and the offsets of the texts in them."""
    sizes = 1 + (symbols > 0xFF) + (symbols > 0xFFFF).astype(np.int64) + (symbols > 0xFFFFFF)
    places = np.r_[0, np.cumsum(sizes)]
    grid = symbols.astype(">u4").view(np.uint8).reshape(-1, 4)
    return grid[np.arange(4) >= 4 - sizes[:, None]], places[offsets]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=ends[1:])
    raw = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    if len(raw) != ends[-1]:  # invalid bytes: text by text
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32) for a, b in zip(offsets, offsets[1:])]
        return np.concatenate([*parts, np.zeros(0, np.uint32)]), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
    return raw, ends[offsets]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and single gaps (0) of each text."""
    points, at = code_points(data, offsets)
    found = _letters()[points]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
    inner = at[(at > 0) & (at < len(found))]
    keep[inner] = True
    places = np.zeros(len(found) + 1, np.int64)
    np.cumsum(keep, out=places[1:])
    return found[keep], places[at]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts exactly the substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def transitions(moves: list[dict[int, int]], size: int) -> np.ndarray:
    """The automaton as one flat table of ``size`` symbols and an end mark: entry ``place of the next row << 2 | phrases that end``.

    Where a text leaves the automaton, its phrase ends and the next begins with this symbol; one that never occurs is a phrase of its own.
    The end mark leads to the start at no cost.
    """
    width = size + 1
    start = np.ones(width, np.int64)  # unknown at the start: a phrase of its own
    for c, q in moves[0].items():
        start[c] = q * width << 2
    grid = np.tile(np.where(start & 3, 2, start + 1), (len(moves), 1))
    grid[0] = start
    grid[:, size] = 0
    for state, out in enumerate(moves):
        row = grid[state]
        for c, q in out.items():
            row[c] = q * width << 2
    return grid.astype(np.int32).ravel()


class Model:
    """Tables of all languages, each over its own bytes."""

    def __init__(self, samples: dict[str, list[str]]):
        texts = {}
        for name, rows in sorted(samples.items()):
            raw = " ".join(rows).encode("utf-8", "replace")
            data = np.frombuffer(raw, np.uint8)
            found, _ = letters(data, np.array([0, len(data)]))
            if (found != 0).any():
                texts[name] = found[:SAMPLE_SYMBOLS]
        self.names = list(texts)
        self.codes, self.tables, sizes = [], [], []
        for found in texts.values():
            data, _ = unpacked(self.symbols()[found], np.array([0, len(found)]))
            own = np.unique(data)
            codes = np.full(256, len(own), np.uint8)  # a byte that the language does not have
            codes[own] = np.arange(len(own))
            codes[END] = len(own) + 1
            self.codes.append(codes)
            self.tables.append(transitions(suffix_automaton(codes[data].tolist()), len(own) + 1))
            sizes.append(len(data))
        self.bits = np.array([np.log2(max(2, n)) for n in sizes])

    def symbols(self) -> np.ndarray:
        """From lower-case letter (0: gap) to its packed bytes."""
        return _packed()

    def phrases(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) under each language (columns)."""
        text, offsets = unpacked(text, offsets)
        sizes = np.diff(offsets)
        chunks = -(-sizes // CHUNK)
        first = np.r_[0, np.cumsum(chunks)]
        grid = np.full((int(first[-1]), CHUNK), END, np.uint8)
        place = np.arange(len(text)) + np.repeat(first[:-1] * CHUNK - offsets[:-1], sizes)
        grid.ravel()[place] = text
        steps = np.ascontiguousarray(grid.T)
        out = np.zeros((len(sizes), len(self.tables)), np.int64)
        for k, (codes, moves) in enumerate(zip(self.codes, self.tables)):
            at = np.zeros(grid.shape[0], np.int32)
            ended = np.zeros(grid.shape[0], np.int32)
            for step in codes[steps]:
                at = moves[(at >> 2) + step]
                ended += at & 3
            sums = np.r_[0, np.cumsum(ended, dtype=np.int64)]
            out[:, k] = sums[first[1:]] - sums[first[:-1]] + chunks  # the phrase that the end of a chunk cuts
        return out


def sample(labelled: DataFrame, text: str, lang: str, rows: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """At most ``rows`` different texts of each language, by the hash of the text; no more than the learned symbols are fetched of one."""
    labelled = labelled.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("text is not null and lang is not null")
    labelled = labelled.withColumns({"digest": digest("text"), "h": F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / (1 << 20)})
    different = labelled.select("lang", "digest").distinct()
    counts = {r.lang: r.n for r in different.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * rows / n))])
    near = labelled.where(F.col("h") < share[F.col("lang")]).select("lang", "digest", "h", F.substring("text", 1, SAMPLE_SYMBOLS).alias("text"))
    near = near.groupBy("lang", "h", "digest").agg(F.collect_set("text")[0].alias("text"))  # copies are one before they are shuffled
    best = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "digest"))).where(F.col("k") <= rows)
    found: dict[str, list[str]] = {}
    for r in best.select("lang", "text", "k").orderBy("lang", "k").collect():
        found.setdefault(r.lang, []).append(r.text)
    return found


PREDICTED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the winner's share of the weights ``2 ** -bits`` over at most 100 symbols."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        model = shared.value
        symbols = model.symbols()
        names, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
        for i, j, data, offsets in by_slice(batch.column(at)):
            found, places = letters(data, offsets)
            has = np.r_[0, np.cumsum(found != 0)]
            m = np.diff(places)
            rows = np.flatnonzero(has[places[1:]] > has[places[:-1]])
            if not len(rows) or not model.names:
                continue
            rate = model.phrases(symbols[found], places)[rows] * model.bits / m[rows, None]
            best = rate.argmin(1)
            weight = np.exp2(np.maximum((rate.min(1)[:, None] - rate) * np.minimum(m[rows, None], 100), -1000))
            names[i + rows] = np.array(model.names, object)[best]
            scores[i + rows] = 1 / weight.sum(1)
        return [pa.array(names.tolist(), pa.string()), pa.array(scores, pa.float64())]

    return extend(docs, PREDICTED, make)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = Model(sample(docs.where(~held), "text", "lang"))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
