"""Language identification: parsing against a slow definition, and held-out accuracy."""

import numpy as np
from conftest_llm import SF

from sessionloom.llm import langid


def slow_phrases(text, training):
    """Longest matches, one after another; a symbol that does not occur is a phrase."""
    count, i = 0, 0
    while i < len(text):
        n = 0
        while i + n < len(text) and text[i : i + n + 1] in training:
            n += 1
        count, i = count + 1, i + max(1, n)
    return count


def test_parse():
    rng = np.random.default_rng(5)
    training = "".join(rng.choice(list("abc "), 300))
    model = langid.Model({"x": [training]})
    norm = lambda t: " ".join(t.split())
    for text in ["abcabc", "zzz", "aaaa bbbb", "a", training, *("".join(rng.choice(list("abcz "), 200)) for _ in range(10))]:
        text = norm(text)
        data = np.frombuffer(text.encode(), np.uint8)
        found, places = langid.letters(data, np.array([0, len(data)]))
        got = model.phrases(model.symbols()[found], places)[0, 0]
        assert got in (slow_phrases(text, norm(training)), slow_phrases(text, norm(training)) + 1)  # +1: the end may fall on a phrase's end


def test_held_out_accuracy(spark):
    rows = langid.op1_language_id(spark, SF.replace("sf0.001", "sf0.01"))
    truth = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "lang", "n_chars")
    pairs = [(r.lang, r.lang_pred) for r in rows.join(truth, "doc_id").where("held_out and n_chars >= 20").collect()]
    assert len(pairs) > 100 and sum(a == b for a, b in pairs) >= 0.97 * len(pairs)
    assert all(0 <= r.score <= 1 for r in rows.collect())


def test_odd_rows(spark):
    texts = [None, "", "123 !!! \n", "é", "the the and the", "日本語", "a" * 70_000]
    df = spark.createDataFrame([(i, t, "en", 1.5) for i, t in enumerate(texts)] + [(None, "the", None, None)] * 2, "doc_id long, text string, lang string, score double")
    model = langid.Model(langid.sample(df, "text", "lang"))
    got = langid.predict(df, model).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))] == ["und"] * 3 + ["en"] * 6
    assert langid.sample(df.limit(0), "text", "lang") == {}
    assert {r.lang_pred for r in langid.predict(df, langid.Model({})).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_scripts_of_many_letters(spark):
    """Each language has letters of its own and, with one other, letters in common; most are none of the 100 most frequent ones."""
    rng = np.random.default_rng(7)
    span = lambda a, b: [chr(c) for c in range(a, b)]
    own = {"en": span(97, 123), "ru": span(0x430, 0x450), "zh": span(0x4E00, 0x5200), "ja": span(0x5100, 0x5500), "ko": span(0xAC00, 0xB000), "xx": span(0x20000, 0x20400)}
    words = {k: ["".join(rng.choice(v, rng.integers(2, 5))) for _ in range(150)] for k, v in own.items()}
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    model = langid.Model({k: [text(k, 600)] for k in own})
    assert len({c for k in own for w in words[k] for c in w}) > 1000
    df = spark.createDataFrame([(k, text(k, 12)) for k in own for _ in range(20)], "lang string, text string")
    assert [(r.lang, r.lang_pred) for r in langid.predict(df, model).collect() if r.lang != r.lang_pred] == []
    data = np.frombuffer("aß 日𠀀".encode(), np.uint8)
    found, places = langid.letters(data, np.array([0, 3, len(data)]))
    got, at = langid.unpacked(model.symbols()[found], places)
    assert bytes(got) == "aß\0日𠀀".encode() and at.tolist() == [0, 3, len(got)]


def test_copies_are_sampled_once(spark):
    rows = [("hot text", "en")] * 3000 + [("text %s" % ("abcdefghij"[i % 10] * (i // 10 + 1)), "en") for i in range(60)] + [("hot text", "de")] * 3
    got = langid.sample(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert sorted(got["en"]) == sorted({t for t, k in rows if k == "en"}) and got["de"] == ["hot text"]
    assert len(set(langid.sample(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", rows=20)["en"])) == 20
