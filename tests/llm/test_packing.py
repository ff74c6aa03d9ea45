"""Packing: ids as the tokenizer gives them, whole and gapless; the curve visits neighbours."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from conftest_llm import SF, documents
from tokenizers import Tokenizer

from sessionloom.llm import packing

PATH = public_tokenizers.path(packing.VOCABULARY)
ODD = ["it's we'll x'S", "Ünï cödé ÆØ ﬁ İstanbul ΣΑΣ", "a\x1cb\x85c\xa0d e", "<|endoftext|> x<|startoftext|>y", "123 4 ab12cd a_b __", "ABC!!! d|e *** %%%", "é ́x", "", "   \n\t ", "日本語テキスト 한국어 🙂🙂"]


def whole(texts):
    return [x.ids for x in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_parts_give_the_ids_of_the_whole(spark):
    texts = ODD + [t for _, t in documents(spark)][:150]
    for limit in (300_000, 7):
        make = packing.Encoder(PATH)
        packing.MOST_CACHED, kept = limit, packing.MOST_CACHED
        try:
            assert [np.frombuffer(make(t), make.kind).tolist() for t in texts] == whole(texts)
        finally:
            packing.MOST_CACHED = kept


def test_marks_and_capitals_make_no_parts_of_their_own():
    make, odd = packing.Encoder(PATH), ["a, b. c.\nd,\te,. f", "it's, x's. İ, ß. ÀÉ, µ. x.", "<|ENDOFTEXT|>, a <|endoftext|>. B", "A1, b2. 3, ), x\x85, y.\x1cz, ª, º.", "É, \xad. \xa0a, ", "DON'T, WE'LL. 'S, a'LL "]
    assert [np.frombuffer(make(t), make.kind).tolist() for t in odd] == whole(odd)
    make = packing.Encoder(PATH)
    make("Word word, word. WORD, Word. word ")
    assert set(make.parts) == {"word", ",", "."}


def test_curve_steps_to_neighbours():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = packing.hilbert(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def check(rows, docs, length):
    """Every id of every document in one piece; sequences full and gapless, but the last."""
    want = defaultdict(list)
    for (doc, text), ids in zip(docs, whole([t for _, t in docs])):
        want[doc].append([*ids, packing.END_ID])
    assert sum(r.length for r in rows) == sum(len(i) for many in want.values() for i in many)
    pieces = defaultdict(list)
    for r in rows:
        ids = next(i for i in want[r.doc_id] if len(i) == r.doc_tokens and zlib.crc32(np.array(i[r.start : r.start + r.length], "<u4")) == r.ids_crc32)
        assert r.length > 0 and r.start + r.length <= len(ids)
        pieces[r.sequence_id].append((r.offset, r.length))
    for number, found in pieces.items():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at == length or number == max(pieces)
    assert sorted(pieces) == list(range(len(pieces)))


def test_query(spark):
    check(packing.op10_curve_packing(spark, SF).collect(), documents(spark), packing.SEQUENCE)


def test_odd_rows(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "x"), (3, "<|endoftext|>"), (5, "same text"), (5, "same text"), (77, "long words " * 3000)]
    df = spark.createDataFrame([(*d, 1, b"z") for d in docs], "doc_id long, text string, n int, ids binary")
    check(packing.pack(df, PATH, 64).collect(), docs, 64)
    assert packing.pack(df.limit(0), PATH).count() == 0
