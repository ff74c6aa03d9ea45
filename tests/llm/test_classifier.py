"""Positive-unlabelled classifier: risk on a toy problem, held-out quality, odd rows."""

import numpy as np
import pytest
from conftest_llm import SF

from sessionloom.llm import classifier

LARGER = SF.replace("sf0.001", "sf0.01")


def test_fit_separates_the_unlabelled():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 0.7, (900, 4)), rng.normal(-1, 0.7, (600, 4))
    model = classifier.fit(good[:400], np.vstack([good[400:], bad]), 500 / 1100)
    assert (model.score(good) >= 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.95


@pytest.mark.parametrize("prior", [0.15, 0.5, 0.85])
@pytest.mark.parametrize("n", [200, 2000])
def test_prior_is_that_of_the_unlabelled(prior, n):
    """Whatever share of the positives is trusted: the estimate knows two samples only."""
    rng = np.random.default_rng(3)
    good = rng.random(2 * n) < prior
    web = np.where(good[:, None], rng.normal(1.5, 1, (2 * n, 4)), rng.normal(-1.5, 1, (2 * n, 4)))
    assert abs(classifier.class_prior(rng.normal(1.5, 1, (n, 4)), web) - prior) < 0.08


def test_one_row_an_id_reaches_the_driver(spark):
    df = spark.range(5000).selectExpr("id % 2 AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(1, 1)] * 50, "doc_id long, quality int")
    rows = classifier.sampled(df, labels, 1, 2).collect()
    assert sorted((r.doc_id, r.trusted) for r in rows) == [(0, False), (1, False), (1, True)]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, classifier.sampled(df.orderBy("text"), labels, 1, 2).collect()))


def test_held_out(spark):
    rows = classifier.op9_quality_classifier(spark, LARGER)
    truth = spark.read.parquet(f"{LARGER}/labels.parquet")
    got = [(r.quality, r.predicted, r.score) for r in rows.join(truth, "doc_id").where("held_out").collect()]
    good = np.array([s for q, _, s in got if q == 1])
    bad = np.array([s for q, _, s in got if q == 0])
    auc = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2
    balanced = ((good >= 0.5).mean() + (bad < 0.5).mean()) / 2
    print("AUC", auc, "balanced accuracy", balanced, len(good), len(bad))
    assert auc > 0.97 and balanced > 0.9
    assert rows.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()


def test_odd_rows(spark):
    texts = [None, "", " \n", "a", "WORD!! WORD!!", "é" * 100_000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, "x", 7)] * 2, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (3, 1), (5, 1), (4, 0), (None, 1), (1, None)], "doc_id long, quality int")
    for model in (classifier.learn(df, labels), classifier.learn(df, labels.where("quality = 0")), classifier.learn(df.limit(0), labels)):
        got = classifier.predict(df, model).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert classifier.predict(df.limit(0), None).count() == 0
