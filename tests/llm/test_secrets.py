"""The secret scan equals plain regular expressions over whole texts."""

import hashlib
import re

import pytest
from conftest_llm import SF, documents

from sessionloom.llm import secrets

KIND_ORDER = list(secrets.RULES)


def plain(text):
    """Every rule over the whole text, in code points."""
    found = []
    for rank, (pattern, group, least) in enumerate(secrets.RULES.values()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[group]) >= least:
                found.append((m.start(), rank, m.end()))
    return [(KIND_ORDER[k], a, b) for a, k, b in sorted(found)]


def row(text):
    spans = plain(text)
    base = [s for s in spans if s[0] in secrets.BASE]
    join = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in xs)
    return (*[sum(k == s[0] for s in spans) for k in secrets.BASE], hashlib.sha256(join(base).encode()).hexdigest(), join(spans))


TEXTS = [
    None,
    "",
    "no secret, password = short",
    'é PassWord = "abcdefghijkl" and token:   AAAAAAAAAAAA/+=.-_ rest',
    "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop",
    "AKIA" + "A" * 14 + " AKIA" + "A" * 13,
    "xyz0123456789abcdefg 0123456789abcde 0123456789ABCDEF01",
    "api_key=0123456789abcdef0123 apikey:'" + "z" * 12 + "'",
    "ghp_" + "a" * 36 + " -----BEGIN RSA PRIVATE KEY-----",
    "secret secret=abcdefghijklm secret=secret=abcdefghijkl",
    "x" * 300_000 + "token=" + "q" * 50_000,
]


def test_every_text_by_hand(spark):
    docs = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(TEXTS)], "doc_id long, text string, secret_spans string")
    got = {r.doc_id: [tuple(s) for s in r.secret_spans] for r in secrets.secret_spans(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}
    assert got[4] == plain(TEXTS[4]) and sum(map(len, got.values())) > 10


def test_query_equals_plain(spark):
    got = {r.doc_id: tuple(r)[1:] for r in secrets.op5_secret_scan(spark, SF).collect()}
    assert got == {i: row(t) for i, t in documents(spark)}
    assert any(r[0] for r in got.values()) or any(r[2] for r in got.values())


@pytest.mark.parametrize("pattern,text", [("a(bc|de)?f+xyz", "abcffxyz"), ("[ab]cd[0-9]{2,3}efg", "bcd12efg"), ("(foo|bar|bazz)+!", "barfoo!"), ("x*", "zzz"), ("(?i)HeLLo w", "hello W")])
def test_a_match_satisfies_its_query(pattern, text):
    query = secrets.trigram_query(pattern)
    low = text.lower()
    holds = lambda q: q is True or (q in low if isinstance(q, str) else (all if q[0] == "and" else any)(map(holds, q[1])))
    assert re.search(pattern, text) and holds(query)


def test_redact(spark):
    docs = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(TEXTS)], "doc_id long, text string, __original string")
    out = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert secrets.redact(docs).columns == docs.columns
    assert out[0].text is None and out[1].text == "" and out[2].text == TEXTS[2] and out[2]["__original"] == "keep"
    for i, t in enumerate(TEXTS):
        assert not plain(out[i].text) and (plain(t) or out[i].text == t)
    assert out[5].text == "[secret] AKIA" + "A" * 13
    assert secrets.redact(docs.limit(0)).count() == 0


def test_rows_repeat_and_empty(spark):
    docs = spark.createDataFrame([(None, TEXTS[3])] * 3, "doc_id long, text string")
    rows = [tuple(map(tuple, r.secret_spans)) for r in secrets.secret_spans(docs).collect()]
    assert len(rows) == 3 and len(set(rows)) == 1 and rows[0]
    assert secrets.secret_spans(docs.limit(0)).collect() == []
