import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import quality, toxicity
from tracewright.llm.linear import apply_logistic, fit_logistic

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    even = labels.where("doc_id % 2 = 0")
    return docs, even, {r["doc_id"]: r for r in labels.where("doc_id % 2 = 1").collect()}


def test_logistic_counts_stand_for_rows():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (200, 3)).astype(float)
    y = (x[:, 0] + rng.random(200) > 0.8).astype(float)
    rows, count = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    assert np.allclose(fit_logistic(x, y), fit_logistic(rows[:, :3], rows[:, 3], count=count), atol=1e-4)
    assert apply_logistic(np.zeros((0, 3)), np.zeros(4)).shape == (0,)


def test_toxicity_on_held_out_labels(labelled):
    docs, even, odd = labelled
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, toxicity.train(docs, even)).drop("rest").collect()}
    assert len(got) == docs.count()
    bad = [got[i]["rejected"] for i, r in odd.items() if r["toxic"] == 1]
    clean = [got[i]["rejected"] for i, r in odd.items() if r["toxic"] == 0]
    assert np.mean(bad) > 0.85 and np.mean(clean) < 0.005  # some labelled toxic texts here hold no toxic word
    assert all(0 <= r[f"p_{c}"] <= 1 for r in got.values() for c in toxicity.CATEGORIES)


def test_toxicity_cases(spark, docs_of):
    rng = random.Random(1)
    plain = ["some plain words that mean well", "other plain words of no harm"]
    texts = [" ".join([rng.choice(plain), "idiot" if i % 4 == 0 else "", f"word{i % 97}"]) for i in range(200)] + [None, "", "x " * 50000 + "idiot"]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(200)] + [(3, 0, 1), (None, 1, 1), (999, 1, 0), (5, None, 1)], "doc_id long, toxic int, quality int")
    docs = docs_of(texts).withColumn("rejected", F.lit("clash")).withColumn("toxic", F.lit(5))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert [got[i]["rejected"] for i in range(203)] == [i % 4 == 0 for i in range(200)] + [False, False, True]
    assert got[4]["rest"]["rejected"] == "clash"
    none = toxicity.train(docs, labels.where("toxic = 7"))
    assert not any(r["rejected"] for r in toxicity.score_toxicity(docs, none).collect())
    assert toxicity.score_toxicity(docs_of([]), none).count() == 0


def test_quality_on_labels(labelled):
    docs, _, odd = labelled
    got = {r["doc_id"]: r for r in quality.score_quality(docs, quality.train(docs, 3000)).collect()}
    good = [got[i]["kept"] for i, r in odd.items() if r["quality"] == 1]
    junk = [got[i]["kept"] for i, r in odd.items() if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(junk) < 0.1


def test_quality_cases(spark, docs_of):
    docs = docs_of([None, "", "word " * 30000, "A plain sentence, with a few words in it. " * 9, "A plain sentence, with a few words in it. " * 9]).withColumn("kept", F.lit("clash"))
    scorer = quality.train(docs)
    got = {r["doc_id"]: r for r in quality.score_quality(docs, scorer).collect()}
    assert got[0]["score"] == got[1]["score"] and got[3]["score"] == got[4]["score"] and got[0]["n_tokens"] == 0
    assert quality.score_quality(docs_of([]), quality.train(docs_of([]))).count() == 0


def test_repeated_ids_stay_within_the_sample(spark, monkeypatch):
    """One id with many rows and texts: the samples are bounded by texts."""
    texts = [f"Text number {i} of one id, with some words in it. " * (i % 5 + 1) for i in range(300)]
    rows = [(7, t) for t in texts] + [(7, texts[0])] * 200 + [(i, texts[1]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    monkeypatch.setattr(quality, "fit_logistic", lambda x, y, **k: seen.append(len(x)) or fit_logistic(x, y, **k))
    scorer = quality.train(docs, 40)
    assert 0 < seen[0] <= 40 and quality.score_quality(docs, scorer).count() == len(rows)
    labels = spark.createDataFrame([(7, 1, 1), (3, 0, 1)], "doc_id long, toxic int, quality int")
    assert toxicity._sample(docs, labels, 25).count() <= 25


def test_labeller_accuracies_are_recovered():
    rng = np.random.default_rng(3)
    good = rng.random(20000) < 0.8
    accuracy = [0.95, 0.9, 0.7, 0.8, 0.55]
    v = np.stack([np.where(rng.random(20000) < 0.2, -1, np.where(rng.random(20000) < a, good, ~good)) for a in accuracy], 1).astype(np.int8)
    patterns, which, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    posterior = quality.estimate(patterns, counts.astype(float))
    assert ((posterior[which] >= 0.5) == good).mean() > 0.95
