"""WARC: what is read back equals what was written; the index finds every capture and no other."""

import gzip
import hashlib
import os

import pytest
from conftest_llm import SF

from sessionloom.llm import warc


def want(pages):
    keeper, count = {}, {}
    for page, _, html in pages:
        b = (html or "").encode()
        if len(b) >= 1000:
            count[b] = count.get(b, 0) + 1
            if page is not None:
                keeper[b] = max(keeper.get(b, page), page)
    out = []
    for page, _, html in pages:
        b = (html or "").encode()
        revisit = count.get(b, 0) > 1 and b in keeper and page != keeper[b]
        out.append((page, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", keeper[b] if revisit else None))
    return sorted(out, key=str)


BIG, BIGGER = "é\r\n\r\n" * 300, "<p>" + "x" * 5000
PAGES = [
    (1, "http://www.Example.com:80/a?b=1#f", BIG),
    (2, "https://user@example.com/", BIG),
    (9, "http://www.example.com/a?b=1", BIG),
    (9, "http://www.example.com/a?b=1", BIG),
    (3, None, None),
    (4, "", ""),
    (5, "no url\n\tX: y", "small"),
    (6, "http://example.com/z", "small"),
    (None, "http://example.com/z", BIG),
    (None, None, BIGGER),
    (None, "http://x.y", BIGGER),
    (7, "http://Z.example.org/ü", "y" * 999),
    (8, "http://z.example.org/ü", "y" * 999),
]


def read_back(spark, tmp_path, pages, name="w"):
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, file int")
    folder = f"file://{tmp_path}/{name}"
    directory = warc.write_archives(df, folder)
    keys = df.select(warc.capture_key("url", "page_id").alias("capture"))
    return df, folder, directory, warc.read_records(warc.look_up(keys, folder), folder, payload=True)


@pytest.mark.parametrize("captures", [500, 2])
def test_round_trip(spark, tmp_path, monkeypatch, captures):
    monkeypatch.setattr(warc, "CAPTURES", captures)
    df, folder, directory, found = read_back(spark, tmp_path, PAGES)
    rows = found.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == want(PAGES)
    stored = {(r.page_id, bytes(r.payload).decode()) for r in rows if r.record_type == "response"}
    assert stored == {(p, h or "") for (p, _, h), w in zip(PAGES, PAGES) if (p, len((h or "").encode())) in {(x[0], x[1]) for x in want(PAGES) if x[3] == "response"}}
    assert directory.count() >= (len(PAGES) // 2 if captures == 2 else 1)
    none = spark.createDataFrame([("com,example)/nothing 00000000000000000001",), ("",), ("zzz",)], "capture string")
    assert warc.look_up(none, folder).count() == 0


def test_archives_are_gzip_members_of_warc(spark, tmp_path):
    read_back(spark, tmp_path, PAGES)
    files = [f for f in os.listdir(tmp_path / "w/archives") if f.endswith(".warc.gz")]
    text = b"".join(gzip.open(tmp_path / "w/archives" / f).read() for f in files)
    assert text.count(b"WARC/1.1\r\n") == len(PAGES) and b"X: y" not in text.replace(b"%%X:%y", b"")


def test_keys(spark):
    df = spark.createDataFrame([(p[1],) for p in PAGES], "u string")
    keys = [r[0] for r in df.select(warc.url_key("u")).collect()]
    assert keys[:3] == ["com,example,www)/a?b=1", "com,example)/", "com,example,www)/a?b=1"]
    assert keys[4] == "" and keys[6] == "no%url%%X:%y"


def test_empty(spark, tmp_path):
    df, folder, directory, found = read_back(spark, tmp_path, PAGES[:1], "one")
    empty = df.limit(0)
    warc.write_archives(empty, f"file://{tmp_path}/none")
    assert warc.look_up(empty.select(warc.capture_key("url", "page_id").alias("capture")), f"file://{tmp_path}/none").count() == 0


def test_query(spark):
    rows = [tuple(r) for r in warc.op7_warc_archive(spark, SF).collect()]
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(rows, key=str) == want(pages)
