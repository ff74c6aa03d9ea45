"""Quality rules: counts by hand, the model's sums, and what the bands keep."""

import re
from collections import Counter

import numpy as np
from conftest_llm import SF, documents

from sessionloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = set()
    for i, w in enumerate(windows):
        if many[w] > 1:
            covered.update(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


ODD = [None, "", " \n\t", "a", "a\n\na\n a\na", "x y z x y z x y z x y z", "é ü\x1cb #*$ <|> 🙂", "w " * 5000, "\n".join(["one two three four five"] * 7)]


def test_counts(spark):
    docs = documents(spark) + [(10**6 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, None if i % 7 == 0 else "en", 5) for i, t in docs], "doc_id long, text string, lang string, n_words int")
    scores = quality.judged(quality.scored(df, quality.train(df)))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in scores.collect()}
    assert got == {i: plain(t) for i, t in docs}


def test_query_keeps_clean_texts(spark):
    rows = quality.op8_quality_rules(spark, SF).collect()
    texts = dict(documents(spark))
    assert len(rows) == len(texts) and not any(r.kept and r.base_failed for r in rows)
    clean = [r for r in rows if not r.base_failed and not re.search(r"[|*$%#]|!!", texts[r.doc_id] or "")]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    text = rng.choice(list(b"abcde "), 3000).astype(np.uint8)
    keys, n = np.unique(quality.grams(text, np.array([0, 1500, 3000])), return_counts=True)
    model = quality.kneser_ney(keys, n)
    for context in (b"abcd", b"aaaa", b"zzzz", b"a be", b"qqqa"):
        packed = np.array([int.from_bytes(context, "big") << 8 | w for w in range(256)], np.uint64)
        assert abs(np.exp(quality.log_probabilities(model, packed).astype(float)).sum() - 1) < 1e-3


def test_bands_reject_noise(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8))) for _ in range(400)]
    good = [(i, " ".join(rng.choice(vocabulary, 120)), "xx") for i in range(300)]
    bad = [(1000 + i, " ".join("".join(rng.choice(list("zqxjkvwfgh0189"), 7)) for _ in range(120)), "xx") for i in range(4)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.quality_filter(df).collect()}
    assert kept == {i for i, _, _ in good}
    assert quality.quality_filter(df).columns == df.columns
    assert quality.quality_filter(df.limit(0)).count() == 0


def test_models_beyond_a_broadcast_are_whole(spark):
    df = spark.createDataFrame([(i, t, "xx" if i % 29 == 0 else None if i % 7 == 0 else "en") for i, t in documents(spark) + [(10**6, None), (5, "again " * 20)]], "doc_id long, text string, lang string")

    def found(most):
        rows = quality.judged(quality.own_scores(df, most=most)(df)).collect()
        return sorted(((r.doc_id, r.text or "", r.n_bytes, r.kept, r.base_failed) for r in rows)), sorted((r.doc_id, r.text or "", r.log_probability) for r in rows)

    whole, cut = found(10**9), found(3000)
    assert cut[0] == whole[0] and len(whole[0]) == df.count()
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) <= 1e-3 + 1e-5 * abs(a[2]) for a, b in zip(whole[1], cut[1]))
    assert sorted(r.doc_id for r in quality.quality_filter(df, most=3000).collect()) == sorted(d for d, *_, kept, _ in whole[0] if kept)
