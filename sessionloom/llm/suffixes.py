"""Substring dedup over windows of bytes by deep-shallow suffix sorting.

Repeats of 200 bytes are found bucket by bucket (see ``repeats``): a bucket holds the distinct super-windows around one anchor. Two windows can be
equal only if the anchor stands at the same place in both, that is if the texts agree for r bytes before the anchor and for 200 - r bytes from
it. Hence the suffixes that begin at the anchors are sorted, and the reversed texts before the anchors too, each with the lengths of the
prefixes that neighbours share; cutting both orders at 200 - r and r gives classes whose pairs are counted for every r.

Sorting is deep-shallow: multikey quicksort orders all suffixes of a task together by blocks of eight bytes to the depth ``SHALLOW``, splitting
groups of equal prefixes only; groups that are still together have a long common prefix and go through a blind trie each, which compares a
suffix in full with a single other one.

Texts are UTF-8 bytes; null is empty. Matches never cross texts, texts shorter than a window lose nothing. Rows that repeat are copies of each
other, and a text of 200 bytes or more that occurs twice is removed whole. Null ids are kept, extra columns ignored; an empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm.common import longs, span_hashes, strings, table, utf8
from sessionloom.llm.repeats import Units, distinct_packs, removed, runs, with_repeats

WINDOW, GRAM = 200, 24
SHALLOW = 32


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Sorts texts that share a long prefix: inner nodes know their depth and the bytes that follow, leaves the texts.

    A new text walks down by its bytes alone, is compared with the leaf that it meets, and is hung in where they part.
    """

    END = -1

    def __init__(self, text: bytes, number: int):
        self.root: list = [len(text), None, text, [number]]  # depth, branches or None for a leaf, text, numbers

    def add(self, text: bytes, number: int) -> None:
        node = self.root
        while node[1] is not None:
            step = text[node[0]] if node[0] < len(text) else self.END
            node = node[1].get(step) or next(iter(node[1].values()))
        shared = shared_prefix(text, node[2])
        if shared == len(text) == len(node[2]):
            node[3].append(number)
            return
        node, at = None, self.root
        while at[1] is not None and at[0] < shared:
            node, at = at, at[1][text[at[0]]]
        leaf = [len(text), None, text, [number]]
        step = text[shared] if shared < len(text) else self.END
        if at[1] is not None and at[0] == shared:
            at[1][step] = leaf
            return
        sample = at
        while sample[1] is not None:
            sample = next(iter(sample[1].values()))
        old = sample[2][shared] if shared < len(sample[2]) else self.END
        split = [shared, {old: at, step: leaf}, None, None]
        if node is None:
            self.root = split
        else:
            node[1][text[node[0]]] = split

    def in_order(self) -> Iterator[tuple[int, int]]:
        """Numbers in the order of their texts, each with the length it shares with the one before (the first: 0)."""
        stack: list[tuple[list, int]] = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if node[1] is None:
                for k, number in enumerate(node[3]):
                    yield number, shared if k == 0 else len(node[2])
            else:
                branches = sorted(node[1].items())
                stack.extend((child, node[0] if k else shared) for k, (_, child) in reversed(list(enumerate(branches))))


def _blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes from a depth as one number that sorts like them; missing bytes are zero."""
    at = starts + depth
    out = np.zeros(len(starts), np.uint64)
    for k in range(8):
        inside = at + k < ends
        out |= np.where(inside, data[np.minimum(at + k, len(data) - 1)], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def deep_shallow(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the texts ``data[start:end]`` within their groups, and the length that each shares with the one before (0 at a group's first)."""
    n = len(starts)
    order = np.argsort(group, kind="stable")
    classes = group[order]
    shared, alone = np.zeros(n, np.int64), 0
    for depth in range(0, SHALLOW, 8):
        same = np.zeros(n + 1, bool)
        same[1:n] = classes[1:] == classes[:-1]
        active = np.flatnonzero(same[:-1] | same[1:])
        if not len(active):
            return order, shared
        rows = order[active]
        block = _blocks(data, starts[rows], ends[rows], depth)
        left = np.minimum(ends[rows] - starts[rows] - depth, 8)  # an end sorts before a zero byte
        sub = np.lexsort((left, block, classes[active]))
        rows, block, left, own = rows[sub], block[sub], left[sub], classes[active][sub]
        order[active] = rows
        new = np.r_[True, (own[1:] != own[:-1]) | (block[1:] != block[:-1]) | (left[1:] != left[:-1])]
        # Neighbours of one class that part here share the bytes before the first that differs.
        part = np.flatnonzero(new[1:] & (own[1:] == own[:-1])) + 1
        differ = block[part] ^ block[part - 1]
        common = sum(((differ >> np.uint64(64 - 8 * k)) == 0).astype(np.int64) for k in range(1, 9))
        shared[active[part]] = depth + np.minimum(common, np.maximum(np.minimum(left[part], left[part - 1]), 0))
        ended = left < 8  # texts that end here and are alike are equal
        classes[active] = np.cumsum(new) + (int(classes.max()) + 1)
        alike = np.flatnonzero(~new & ended)
        shared[active[alike]] = depth + np.maximum(left[alike], 0)
        done = active[np.flatnonzero(ended)]
        classes[done] = -1 - alone - np.arange(len(done))  # each on its own from here
        alone += len(done)
    first = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])
    sizes = np.diff(np.r_[first, n])
    raw = data.tobytes()
    for a, size in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        rows = order[a : a + size].tolist()
        trie = BlindTrie(raw[starts[rows[0]] + SHALLOW : ends[rows[0]]], rows[0])
        for r in rows[1:]:
            trie.add(raw[starts[r] + SHALLOW : ends[r]], r)
        for k, (r, length) in enumerate(trie.in_order()):
            order[a + k] = r
            if k:
                shared[a + k] = SHALLOW + length
    return order, shared


def _classes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """Class of each text by its first ``depth`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def repeated_windows(data, lo, at, hi, end, base, group, weights) -> list[np.ndarray]:
    """For each distance from anchor back to window start: which rows' windows occur twice. ``data[base:end]`` are the rows' bytes;
    ``lo, at, hi`` the places of their first window, anchor and last window within the text that ``base`` is place ``lo`` of."""
    anchor = base + at - lo
    ahead = deep_shallow(data, anchor, end, group)
    size = len(data)
    behind = deep_shallow(data[::-1].copy(), size - anchor, size - base, group)
    out = []
    for r in range(int((at - lo).max()) + 1):
        valid = np.flatnonzero((at - r >= lo) & (at - r <= hi))
        if len(valid):
            both = _classes(*ahead, WINDOW - r)[valid] << 32 | (_classes(*behind, r) if r else group)[valid]
            _, which = np.unique(both, return_inverse=True)
            out.append((r, valid[np.bincount(which, weights=weights[valid])[which] > 1]))
    return out


def _bucket(packs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeats as (row of the table, first byte, end)."""
    first, which, n = distinct_packs(packs)
    lo, hi, at = (packs.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "at"))
    _, group = np.unique(packs.column("hash").to_numpy()[first], return_inverse=True)
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    covered: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if len(several):
        data, offsets = utf8(packs.column("payload").combine_chunks().take(pa.array(first[several])))
        rows = first[several]
        found = repeated_windows(data, lo[rows], at[rows], hi[rows], offsets[1:], offsets[:-1], group[several], n[several])
        owner = np.concatenate([h for _, h in found])
        place = np.concatenate([at[rows][h] - r - lo[rows][h] for r, h in found])
        order = np.lexsort((place, owner))
        who, a, b = runs(np.ones(len(owner), bool), owner[order], place[order])
        bounds = np.searchsorted(who, np.arange(len(several) + 1))
        covered = {int(several[k]): (a[bounds[k] : bounds[k + 1]], b[bounds[k] : bounds[k + 1]]) for k in range(len(several))}
    out: list[list[int]] = [[], [], []]
    for row, kind in enumerate(which.tolist()):
        if n[kind] > 1:
            spans = [(0, int(hi[row] - lo[row]))]
        else:
            spans = zip(*covered[kind]) if kind in covered else ()
        for a, b in spans:
            for column, value in zip(out, (row, lo[row] + a, lo[row] + b + WINDOW)):
                column.append(int(value))
    return tuple(np.array(c, np.int64) for c in out)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros(len(data), np.uint64)
    at = np.arange(len(data) - GRAM + 1)
    if len(at):
        out[: len(at)] = span_hashes(data, at, at + GRAM)
    return out, offsets


def _prints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((2, len(data)), np.uint64)
    at = np.arange(len(data) - WINDOW + 1)
    if len(at):
        out[0, : len(at)] = span_hashes(data, at, at + WINDOW)
        out[1, : len(at)] = span_hashes(data[::-1].copy(), len(data) - at - WINDOW, len(data) - at)  # read backwards: another polynomial
    return out[0], out[1]


UNITS = Units(WINDOW, GRAM, _grams, lambda raw: lambda a, b: raw[a:b], _prints, _bucket)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        data, offsets = utf8(batch.column("text"))
        for i, (spans, copied) in enumerate(zip(batch.column("repeats").to_pylist(), batch.column("copied").to_pylist())):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            gone = removed(len(raw), spans, copied, WINDOW)
            edges = [0, *(x for span in gone for x in span), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            for column, value in zip(out, (len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept)):
                column.append(value)
        arrays = [batch.column("doc_id"), *map(longs, out[:3]), strings(out[3]), pa.array(out[4], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)``: each text without the bytes that a repeated string of 200 covers."""
    slim = docs.selectExpr(f"`{key}` as doc_id", f"cast(`{text}` as string) as text")
    found = with_repeats(slim, UNITS).select("doc_id", "text", "copied", "repeats")
    return found.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text that strings of 200 bytes which occur elsewhere leave."""
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
s AS (SELECT rid, b, unnest(range(0, CAST(strlen(b) / 2 AS BIGINT) - 199)) AS s FROM d),
win AS (SELECT rid, s, md5(substr(b, 2 * s + 1, 400)) AS h FROM s),
dup AS (SELECT rid, s FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
part AS (SELECT rid, s, s - lag(s) OVER w > 200 AS apart FROM dup WINDOW w AS (PARTITION BY rid ORDER BY s)),
run AS (SELECT rid, s, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY s) AS k FROM part),
span AS (SELECT rid, k, min(s) AS a, max(s) + 200 AS e FROM run GROUP BY rid, k),
edge AS (SELECT rid, a, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY a), 0) AS since FROM span),
total AS (SELECT rid, sum(e - a) AS n, count(*) AS spans, max(e) AS last, string_agg(substr(b, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS t
          FROM edge JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(strlen(b) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(t, '') || substr(b, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN total USING (rid)
"""
