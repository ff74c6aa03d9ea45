"""Secret scan with a trigram index.

Every Spark task indexes its own batch of documents, as search engines shard an index by document: for the trigrams that any rule needs, the
postings list the documents that hold them. A rule's Boolean trigram query is derived from its regular expression; its postings are
intersected and united, and only the documents left are matched in full. A rule without mandatory trigrams matches every document. The index
can only leave out documents that cannot match, so the result equals a full scan. No shuffle; one hot source or text is no special case.

Null texts are empty. Spans are code points of the whole text, end exclusive. Columns besides the text are passed through; a column named like
the output is replaced. Repeated rows give repeated results, an empty table gives an empty one.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from re import _constants as op
from re import _parser

from sessionloom.llm.common import FOLD, by_slice, extend, table

# The kinds in their order, pattern, group whose length counts, least length. A match that is too short is dropped.
RULES = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    # Runs of this class cannot overlap or touch, so asking for 16 in the pattern is the same as dropping shorter ones.
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "private_key": (r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0),
    "code_host": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    "cloud": (r"AIza[0-9A-Za-z_-]{35}", 0, 0),
    "web_token": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
}
BASE = ("assign", "access", "hex")
MOST_STRINGS = 64
SPANS = T.StructField("secret_spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

# A query is True (no demand), a trigram, or ("and" | "or", queries).


def _all(*queries):
    rest = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not rest else rest[0] if len(rest) == 1 else ("and", tuple(rest))


def _any(*queries):
    rest = list(dict.fromkeys(queries))
    return True if True in rest or not rest else rest[0] if len(rest) == 1 else ("or", tuple(rest))


def _of_strings(texts: set[str]):
    least = sorted(t for t in texts if not any(u != t and u in t for u in texts))  # a longer string demands more than its part
    return _any(*(_all(*(t[i : i + 3] for i in range(len(t) - 2))) for t in least))


def _members(items) -> set[str] | None:
    """The characters of a class, if they are few."""
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= 8 else None


def _analyse(sequence) -> tuple[set[str] | None, object]:
    """The strings a pattern can be, if they are few and known, and else None; and the trigram query of what else it demands."""
    known: set[str] = {""}
    demands, whole = [], True

    def close():
        nonlocal known, whole
        demands.append(_of_strings(known))
        known, whole = {""}, False

    for kind, value in sequence:
        texts, query = None, True
        if kind is op.LITERAL:
            texts = {chr(value).lower()}
        elif kind is op.IN:
            texts = _members(value)
        elif kind is op.SUBPATTERN:
            texts, query = _analyse(value[-1])
        elif kind is op.BRANCH:
            parts = [_analyse(p) for p in value[1]]
            if all(t is not None for t, _ in parts):
                texts = set().union(*(t for t, _ in parts))
            query = _any(*(q if t is None else _of_strings(t) for t, q in parts)) if texts is None else True
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, body = value
            texts, query = _analyse(body)
            if least == 0:
                texts, query = (texts | {""} if texts is not None and most == 1 else None), True
            elif most != 1:
                texts, query = None, query if texts is None else _of_strings(texts)
        elif kind is op.AT:
            continue
        if texts is not None and len(known) * len(texts) <= MOST_STRINGS:
            known = {a + b for a, b in product(known, texts)}
        else:
            close()
            if texts is not None:
                demands.append(_of_strings(texts))
            demands.append(query)
    if whole:
        return known, True
    close()
    return None, _all(*demands)


def trigram_query(pattern: str):
    """What a text must hold for the pattern to match, over lower-cased ASCII trigrams."""
    texts, query = _analyse(_parser.parse(pattern))
    return _of_strings(texts) if texts is not None else query


def trigrams_of(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


@cache
def _compiled(names: tuple[str, ...]):
    """Matchers, queries, and the table from a trigram to its number (0: no rule needs it)."""
    queries = {n: trigram_query(RULES[n][0]) for n in names}
    needed = sorted(set().union(*map(trigrams_of, queries.values())))
    number = np.zeros(1 << 24, np.uint8 if len(needed) < 255 else np.uint16)
    for i, t in enumerate(needed, 1):
        a, b, c = t.encode()
        number[a << 16 | b << 8 | c] = i
    return {n: re.compile(RULES[n][0].encode()) for n in names}, queries, {t: i for i, t in enumerate(needed, 1)}, number


def postings(data: np.ndarray, offsets: np.ndarray, number: np.ndarray) -> dict[int, np.ndarray]:
    """For each needed trigram the ordered documents that hold it."""
    if len(data) < 3:
        return {}
    low = FOLD[data].astype(np.uint32)
    found = number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
    at = np.flatnonzero(found)
    doc = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[doc + 1]
    entries = np.unique(found[at[inside]].astype(np.int64) << 32 | doc[inside])
    numbers, docs = entries >> 32, entries & 0xFFFFFFFF
    first = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else []
    return {int(numbers[a]): docs[a:b] for a, b in zip(first, [*first[1:], len(numbers)])}


def candidates(query, index: dict[int, np.ndarray], numbers: dict[str, int], rows: int) -> np.ndarray:
    if query is True:
        return np.arange(rows)
    if isinstance(query, str):
        return index.get(numbers[query], np.zeros(0, np.int64))
    parts = [candidates(q, index, numbers, rows) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(parts))
    parts.sort(key=len)
    left = parts[0]
    for p in parts[1:]:
        left = np.intersect1d(left, p, assume_unique=True)
    return left


def _spans(column: pa.Array, names: tuple[str, ...]) -> pa.Array:
    matchers, queries, numbers, number = _compiled(names)
    rows: list[list[dict]] = [[] for _ in range(len(column))]
    for i, j, data, offsets in by_slice(column):
        index = postings(data, offsets, number)
        found: dict[int, list[tuple[int, int, int]]] = {}
        raw = data.tobytes()
        for rank, name in enumerate(names):
            _, group, least = RULES[name]
            for doc in candidates(queries[name], index, numbers, j - i).tolist():
                for m in matchers[name].finditer(raw[offsets[doc] : offsets[doc + 1]]):
                    if m.end(group) - m.start(group) >= least:
                        found.setdefault(doc, []).append((m.start(), rank, m.end()))
        for doc, spans in found.items():
            points = np.zeros(offsets[doc + 1] - offsets[doc] + 1, np.int64)
            np.cumsum((data[offsets[doc] : offsets[doc + 1]] & 0xC0) != 0x80, out=points[1:])
            rows[i + doc] = [{"kind": names[k], "start": int(points[a]), "end": int(points[b])} for a, k, b in sorted(spans)]
    return pa.array(rows, _SPANS)


def secret_spans(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """Add ``secret_spans``: every match of every kind, by start and then by the order of the kinds. None found: an empty list."""
    at = docs.columns.index(text)
    return extend(docs, [SPANS], lambda batch: [_spans(batch.column(at), kinds)])


def redact(docs: DataFrame, text: str = "text", marker: str = "[secret]") -> DataFrame:
    """Replace each run of overlapping or touching spans by one marker. A null text stays null, all columns keep their place."""
    columns, found = docs.columns, secret_spans(docs.withColumn("__original", F.struct(*[f"`{c}`" for c in docs.columns])).select(F.col(f"`{text}`").alias(text), "__original"), text)
    fresh = F.aggregate(
        "secret_spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done")),
        lambda acc, s: F.when(s["end"] <= acc["done"], acc).otherwise(
            F.struct(
                F.when((s["start"] > acc["done"]) | (acc["done"] == 0), F.concat(acc["out"], _cut(text, acc["done"], s["start"]), F.lit(marker))).otherwise(acc["out"]).alias("out"),
                s["end"].alias("done"),
            )
        ),
        lambda acc: F.concat(acc["out"], _cut(text, acc["done"], F.length(f"`{text}`"))),
    )
    clean = F.when(F.size("secret_spans") > 0, fresh).otherwise(F.col(f"`{text}`"))
    return found.select(*[(clean if c == text else F.col("__original")[c]).alias(c) for c in columns])


def _cut(text: str, start, end):
    return F.substring(F.col(f"`{text}`"), (start + 1).cast("int"), (end - start).cast("int"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: counts of the base kinds, a digest of their spans, and all spans."""
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("secret_spans")).alias("spans"),
    )
