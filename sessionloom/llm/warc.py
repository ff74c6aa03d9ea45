"""WARC archives with revisit records and a two-level capture index.

Writing: every task appends the records of its rows to an archive file of its own, one gzip member each, and returns a line per record (key, file,
offset, length). Only lines of tasks that ended well are stored, so files that a lost or repeated task leaves behind are never read.

Index: the capture key is the URL with its host reversed (``com,example,www)/path?query``), then the page id. Lines are range-sorted by key and
packed into compressed blocks of ``CAPTURES`` lines; the sparse directory has a row per block. A look-up reads the part of the directory that
covers its (ordered) keys, finds the block by binary search, reads and opens that block only, and then reads the records' byte ranges.

Equal payloads of ``LEAST_BYTES`` bytes or more are stored once, with the record of the largest page id; the others revisit it. Their size is in
the stored HTTP header. A hot payload, host or URL is spread by Spark's join and by the page id in the sort key.

Null html is an empty payload, a null URL an empty key. Rows with the largest page id that repeat are all responses; a row with a null page id
revisits if a page with an id has its payload. Repeated rows are records of their own. An empty table gives empty archives. Other columns are
ignored.

Files are reached through pyarrow's file systems, by the URI of the shared folder; nothing is kept in local folders.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import table, written
from sessionloom.session import shared_dir

LEAST_BYTES = 1000
CAPTURES = 500
FILE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
NAME = "urn:page:"
# Fixed value: the profile of a revisit of an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> Column:
    """Reversed-host form of a URL, without scheme, user, port and fragment; blanks and control characters are percent signs."""
    source = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\\x00-\\x20]", "%")
    parts = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?([^#]*)"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(source, parts, 1)), "\\.")), ",")
    return F.when(source.rlike(parts), F.concat(host, F.lit(")"), F.regexp_extract(source, parts, 2))).otherwise(source)


def capture_key(url: str, page: str) -> Column:
    return F.concat(url_key(url), F.lit(" "), F.coalesce(F.lpad(F.col(page).cast("string"), 20, "0"), F.lit("")))


def _header(fields: list[tuple[str, object]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields), "", ""]).encode()


def record(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record."""
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Target-URI", re.sub("[\x00-\x20]", "%", url)),
        ("WARC-Date", DATE),
        ("WARC-Record-ID", f"<{NAME}{'' if page is None else page}>"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ]
    if revisit:
        fields += [("WARC-Refers-To", f"<{NAME}{refers_to}>"), ("WARC-Profile", PROFILE)]
    return _header(fields, "WARC/1.1") + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The record of one gzip member; a response's payload is held against its digest."""
    text = zlib.decompress(raw, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(x) if (x := fields.get(name, "").strip("<>").removeprefix(NAME)) else None
    return {"page_id": number("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": payload}


def _opened(folder: str):
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Files:
    """Files of one task attempt, a new one after ``FILE_BYTES``."""

    def __init__(self, folder: str, suffix: str):
        (self.system, self.folder), self.suffix, self.stream = _opened(folder), suffix, None

    def append(self, data: bytes) -> tuple[str, int, int]:
        if self.stream is None or self.at >= FILE_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.system.create_dir(self.folder, recursive=True)
            self.stream = self.system.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.stream.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()


def _write_records(folder: str):
    names = ["capture", "file", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, ".warc.gz")
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for capture, page, url, html, digest, keeper, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                place = files.append(_member(record(page, url or "", (html or "").encode(), digest, keeper, revisit)))
                for column, value in zip(out, (capture, *place)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=names)
        files.close()

    return run


DIRECTORY = ["first", "last", "file", "offset", "length"]


def _write_blocks(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, ".cdx.gz")
        lines: list[tuple] = []

        def block() -> pa.RecordBatch:
            part, lines[:] = lines[:CAPTURES], lines[CAPTURES:]
            place = files.append(_member("\n".join("\t".join(map(str, x)) for x in part).encode()))
            row = (part[0][0], part[-1][0], *place)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(),) * 3 + (pa.int64(),) * 2)], names=DIRECTORY)

        for batch in batches:
            lines.extend(zip(*(c.to_pylist() for c in batch.columns)))
            while len(lines) >= CAPTURES:
                yield block()
        if lines:
            yield block()
        files.close()

    return run


def write_archives(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives and the index below a shared folder; returns the directory, which is stored there as ``directory``."""
    rows = pages.select(F.col(f"`{page}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    same = rows.where(F.octet_length("html") >= LEAST_BYTES).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    same = same.where("n > 1 and keeper is not null").drop("n")
    kinds = rows.join(same, "digest", "left").withColumn("revisit", F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")))
    lines = kinds.select(capture_key("url", "page_id").alias("capture"), "page_id", "url", "html", "digest", "keeper", "revisit").mapInArrow(
        _write_records(f"{folder}/archives"), "capture string, file string, offset long, length long"
    )
    lines = written(lines, "captures")  # only here are the archives written
    blocks = lines.repartitionByRange("capture", "file", "offset").sortWithinPartitions("capture", "file", "offset")
    blocks = blocks.mapInArrow(_write_blocks(f"{folder}/index"), "first string, last string, file string, offset long, length long")
    blocks.write.parquet(f"{folder}/directory")
    return pages.sparkSession.read.parquet(f"{folder}/directory")


class Index:
    """Binary search over the part of the directory that covers a range of keys; opened blocks are kept one at a time."""

    def __init__(self, folder: str, low: str, high: str):
        self.system, root = _opened(folder)
        self.folder = f"{root}/index"
        rows = ds.dataset(f"{root}/directory", filesystem=self.system, format="parquet").to_table(filter=(pc.field("first") <= high) & (pc.field("last") >= low))
        self.blocks = sorted(zip(*(rows.column(c).to_pylist() for c in DIRECTORY)), key=lambda b: (b[0].encode(), b[1].encode()))
        self.last = [b[1].encode() for b in self.blocks]
        self.held: tuple[int, list] = (-1, [])

    def _lines(self, k: int) -> list[list[str]]:
        if self.held[0] != k:
            _, _, name, offset, length = self.blocks[k]
            with self.system.open_input_file(f"{self.folder}/{name}") as f:
                f.seek(offset)
                self.held = k, [x.split("\t") for x in zlib.decompress(f.read(length), 31).decode().split("\n")]
        return self.held[1]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Places of all captures under a key."""
        k = bisect.bisect_left(self.last, key.encode())
        while k < len(self.blocks) and self.blocks[k][0].encode() <= key.encode():
            lines = self._lines(k)
            at = bisect.bisect_left(lines, key.encode(), key=lambda x: x[0].encode())
            while at < len(lines) and lines[at][0] == key:
                yield lines[at][1], int(lines[at][2]), int(lines[at][3])
                at += 1
            k += 1


def look_up(keys: DataFrame, folder: str) -> DataFrame:
    """``(capture, file, offset, length)`` of every capture under the keys of ``keys(capture)``; keys without one give no row."""
    names = ["capture", "file", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            if not wanted:
                continue
            index = Index(folder, wanted[0], wanted[-1])
            rows = [(k, *place) for k in wanted for place in index.find(k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=names)

    asked = keys.select("capture").distinct().repartitionByRange("capture").sortWithinPartitions("capture")
    return asked.mapInArrow(run, "capture string, file string, offset long, length long")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(places: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records at ``places(file, offset, length)``, by byte ranges in file order; with their payloads if asked (empty for a revisit)."""
    schema = READ + (", payload binary" if payload else "")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        name, stream = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if stream is not None:
                        stream.close()
                    name, stream = file, system.open_input_file(f"{root}/archives/{file}")
                stream.seek(offset)
                rows.append(parsed(stream.read(length)))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds)], names=names)
        if stream is not None:
            stream.close()

    ordered = places.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, schema)


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, look every page up in the index and read its record back."""
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return read_records(look_up(pages.select(capture_key("url", "page_id").alias("capture")), folder), folder)


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper, count(*) AS n FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN k.n > 1 AND d.page_id <> k.keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.n > 1 AND d.page_id <> k.keeper THEN k.keeper END AS refers_to
FROM d LEFT JOIN k ON d.payload_digest = k.payload_digest
"""
