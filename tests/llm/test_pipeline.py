"""Each stage of the pipeline against brute force on its own input."""

import corpus_pipeline
import pytest
from conftest_llm import SF
from test_decontaminate import brute as leaks
from test_neardup import brute as similar_groups
from test_packing import check as check_packing
from test_quality import plain as counts
from test_secrets import plain as found_secrets

from sessionloom.llm import neardup, packing, quality
from sessionloom.llm.common import written


@pytest.fixture(scope="module")
def outputs(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], SF), "stage"))
    return docs


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns_stay(outputs):
    assert all(d.dtypes == outputs[0].dtypes for d in outputs[:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_quality(outputs):
    before, after = texts(outputs[0]), texts(outputs[1])
    verdict = {r.doc_id: r.kept for r in quality.judged(quality.scored(outputs[0], quality.train(outputs[0]))).collect()}
    assert after == [(i, t) for i, t in before if verdict[i]]
    assert not any(counts(t)[-1] for _, t in after)


def test_near_dedup(outputs):
    before, after = texts(outputs[1]), texts(outputs[2])
    groups = similar_groups(before, neardup.inverse_frequencies(outputs[1]))
    assert [i for i, _ in after] == sorted(min(g) for g in groups)


def test_decontamination(spark, outputs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(outputs[2]), texts(outputs[3])
    dirty = {i for i, _ in leaks(before, items)}
    assert after == [(i, t) for i, t in before if i not in dirty]


def test_secrets(outputs):
    before, after = dict(texts(outputs[3])), dict(texts(outputs[4]))
    assert before.keys() == after.keys()
    assert all(not found_secrets(t) for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not found_secrets(t))
    assert all(r.n_chars == len(r.text) for r in outputs[4].collect())


def test_packing(outputs):
    check_packing(outputs[5].collect(), texts(outputs[4]), packing.SEQUENCE)


def test_run(spark, outputs):
    rows = corpus_pipeline.run(spark, SF)
    total = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    whole = lambda df: sorted({(r.doc_id, r.doc_tokens) for r in df.collect()})
    assert whole(rows) == whole(outputs[5]) and len(total(rows)) > 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
