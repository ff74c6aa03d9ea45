"""Packing along a space-filling curve.

1. Every document is turned into token ids once; its hashed token vector is projected to three dimensions, whose Hilbert key orders documents
   so that neighbours on the curve have similar content. Ids and key go to a table in the shared folder.
2. Only (key, id, length) is range-sorted. Each partition adds up lengths as it goes, one total per partition gives its start on the curve.
3. A document then knows its place in the one long stream of tokens and is cut at multiples of the sequence length, row by row.

Only the last sequence of the whole corpus can need padding. Equal documents differ in the sort key by their row number, so a hot group spreads
over partitions; a document of any length is cut into as many pieces as it needs.

Null text counts as empty: such a document has the end id only. Rows that repeat are packed as often as they occur; a null id is kept. An empty
table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from sessionloom.llm.common import longs, table, written

SEQUENCE = 4096
END_ID = 2
DIMENSIONS, BITS, BUCKETS = 3, 10, 256
MOST_CACHED = 500_000
VOCABULARY = "word_bpe_49k.json"

# Separators of str.split() that are no blanks in Unicode.
_ODD = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")
# A word of Latin letters and the marks behind it: two pre-tokens whatever their case.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|*%$&#]*)")
# A mark between a letter and a blank: a part of its own, so that a word is known whatever follows it.
_MARK = re.compile(r"(?<=[a-zß-öø-ÿ])[.,](?=[ \n])")


class Encoder:
    """Ids of texts, put together from those of their blank-separated parts, of which many repeat.

    For byte-level tokenizers that drop blanks and never join text across them, fold case and keep letters apart from marks. A lower-case word of
    letters is then one piece for the tokenizer's model; any other part goes through the whole tokenizer. The caches are bounded.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the parts before these; those still in use are taken over
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _part(self, part: str) -> bytes:
        if not part:
            return b""
        found = self.older.get(part)
        if found is None:
            if simple := _SIMPLE.fullmatch(part):
                word, marks = simple.groups()
                low = word.lower()
                if low == part:
                    piece = low if low.isascii() else self.bytes.pre_tokenize_str(low)[0][0]  # letters of ASCII stand for themselves
                    found = np.array([t.id for t in self.model.tokenize(piece)], self.kind).tobytes()
                else:
                    found = (self.parts.get(low) or self._part(low)) + self._part(marks)
            else:
                found = self._whole(part)
        if len(self.parts) >= MOST_CACHED:
            self.older, self.parts = self.parts, {}
        self.parts[part] = found
        return found

    @staticmethod
    def _plain(text: str) -> str:
        """The same ids from fewer different parts. Beyond Latin-1 and beside special tokens, case folding is left to the tokenizer."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text if "<|" in text else _MARK.sub(r" \g<0>", text.lower())

    def __call__(self, text: str) -> bytes:
        text = self._plain(text) if text else ""
        found = (_BLANKS.split(text) if _ODD.search(text) else text.split()) if text else []
        known = self.parts.get
        return b"".join([known(p) or self._part(p) for p in found])


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of coordinates below ``2**bits`` (transposed form by exclusive ors, then interleaved)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        fix ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= fix
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


@cache
def _projection(vocabulary: int) -> np.ndarray:
    """Each id's hashed coordinate, projected: a row per id."""
    rng = np.random.default_rng(7)
    bucket = (np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(np.log2(BUCKETS)))
    return rng.standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)[bucket]


def curve_keys(ids: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """Hilbert keys of documents given as id arrays; a document without ids lies in the middle."""
    rows = _projection(vocabulary)
    means = np.array([rows[x].mean(0) if len(x) else np.zeros(DIMENSIONS) for x in ids], np.float64).reshape(-1, DIMENSIONS)
    return hilbert(((np.tanh(2 * means) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64))


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(uid, doc_id, n, curve, ids)`` of every row; ids as little-endian bytes with the end id last."""
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = encoder(path)
        size = max(make.tokenizer.get_vocab_size(), end_id + 1)
        last = np.array([end_id], make.kind).tobytes()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 200):
                raw = [make(t) for t in texts[a : a + 200]]
                arrays = [np.frombuffer(r, make.kind) for r in raw]
                keys = curve_keys(arrays, size)
                yield pa.RecordBatch.from_arrays(
                    [longs(np.arange(row, row + len(raw))), batch.column(0)[a : a + 200], longs([len(x) + 1 for x in arrays]), longs(keys), pa.array([r + last for r in raw], pa.binary())],
                    names=["uid", "doc_id", "n", "curve", "ids"],
                )
                row += len(raw)

    return slim.mapInArrow(run, "uid long, doc_id long, n long, curve long, ids binary")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(2).to_numpy()
        before = done + np.cumsum(n) - n
        done += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column(0), longs(np.full(len(n), part)), longs(before), batch.column(2)], names=["uid", "part", "before", "n"])


def places(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(uid, part, before)`` in curve order and ``(part, start)``: a document's first token is number start + before of the stream."""
    order = tokens.select("curve", "uid", "n").repartitionByRange("curve", "uid").sortWithinPartitions("curve", "uid")
    sums = written(order.select("uid", "curve", "n").mapInArrow(_running, "uid long, part long, before long, n long"), "packing-places")
    totals = sums.groupBy("part").agg(F.sum("n").alias("total"))
    # A row per partition of the sort.
    starts = totals.selectExpr("part", "sum(total) over (order by part) - total as start")
    return sums.select("uid", "part", "before"), starts


PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pieces(kind: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, raw, first in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("first").to_pylist()):
                ids = np.frombuffer(raw.as_buffer(), kind).astype("<u4")
                cuts = [0, *range(length - first % length, len(ids), length), len(ids)]
                for a, b in zip(cuts, cuts[1:]):
                    at = first + a
                    for column, value in zip(out, (doc, a, b - a, zlib.crc32(ids[a:b]), len(ids), at // length, at % length)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=PIECES)

    return run


def pack(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens. Every id lies in one piece; sequences have no gaps and only the last is short."""
    tokens = written(tokenized(docs, path, end_id, key, text), "packing-tokens")
    kind = "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    sums, starts = places(tokens)
    placed = (
        tokens.select("uid", "doc_id", "ids")
        .join(sums, "uid")
        .join(F.broadcast(starts), "part")  # a row per partition of the sort
        .select("doc_id", "ids", (F.col("start") + F.col("before")).alias("first"))
    )
    return placed.mapInArrow(_pieces(kind, length), ", ".join(f"{c} long" for c in PIECES))


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
