"""Trained models against plain forms of themselves, rollups with several writers, and the pipeline on empty tables."""

import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuetrail.llm import quality, rollups, toxicity, trees
from cuetrail.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


def walked(forest, row):
    """One row's score, node by node."""
    total = forest.base
    for at in forest.roots:
        while forest.left[at] != at:
            at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        total += forest.value[at]
    return 1 / (1 + np.exp(-total))


@pytest.mark.parametrize("direction", [0, 1, -1])
def test_forest_scores_as_a_walk_of_its_trees(direction):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 4)), 1)  # with ties
    y = x[:, 0] + x[:, 1] * x[:, 2] > 0
    forest = trees.fit(x, y, np.array([direction, 0, 0, 0]), trees=15)
    assert len(forest.roots) == 15 and len(forest.feature) > 60
    np.testing.assert_allclose(forest.score(x), [walked(forest, r) for r in x], rtol=1e-12)


def test_quality_verdicts_by_a_walk_of_the_trees(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    forest = quality.train(docs, labels)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = quality.judge(docs, forest).collect()
    assert len(rows) == len(texts) and len({r.kept for r in rows}) == 2
    for r in rows:
        base, features = quality.statistics([texts[r.doc_id]])
        plain = walked(forest, features[0])
        assert abs(plain - r.quality) < 1e-12
        failed = base[0][0] < 10 or 100 * base[0][4] > 20 * base[0][0]
        assert (r.base_failed, r.kept) == (failed, not failed and plain >= 0.5)


def instances(seed=5, docs=40, features=6):
    """Documents of one to four sentences with the features of each, and labels."""
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 5, docs)
    on = [rng.random((k, features)) < 0.4 for k in n]
    labels = np.array([(m[:, 0] & ~m[:, 1]).any() for m in on]).astype(int)
    labels[:4] = 1 - labels[:4]
    return n, on, labels


def loss(on, labels, w, bias, ridge):
    total = 0.0
    for m, y in zip(on, labels, strict=True):
        none = np.prod(1 - 1 / (1 + np.exp(-(bias + m @ w))))
        total -= np.log(1 - none) if y else np.log(none)
    return total / len(labels) + ridge / 2 * float(w @ w)


def slope(on, labels, w, bias, ridge, h=1e-6):
    """The numeric gradient of the loss by the weights and the bias."""
    at = np.append(w, bias)
    f = lambda v: loss(on, labels, v[:-1], v[-1], ridge)
    return np.array([(f(at + h * e) - f(at - h * e)) / (2 * h) for e in np.eye(len(at))])


def test_noisy_or_follows_the_numeric_gradient():
    n, on, labels = instances()
    columns, sentences = [np.nonzero(m)[1] for m in on], [np.nonzero(m)[0] for m in on]
    start = np.log(labels.mean() / (n.sum() / len(n)))
    w, bias = toxicity.fit(columns, sentences, n, labels, 6, rounds=1, rate=0.1, ridge=0.01)
    # the first step of Adam goes by the rate against the sign of the gradient
    g = slope(on, labels, np.zeros(6), start, 0.01)
    np.testing.assert_allclose(np.append(w, bias - start), -0.1 * np.sign(g), rtol=1e-4)
    w, bias = toxicity.fit(columns, sentences, n, labels, 6, rounds=3000, rate=0.02, ridge=0.01)
    assert np.abs(slope(on, labels, w, bias, 0.01)).max() < 1e-3
    assert w[0] > 0 > w[1]


def test_rollups_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = shared_dir(spark)
    assert rollups.totals(spark, path).count() == 0
    rollups.commit(rollups.inserts(docs.limit(0)), path, "none")
    assert rollups.totals(spark, path).count() == 0
    rollups.commit(rollups.inserts(docs.limit(1).withColumn("source", F.lit(None).cast("string"))), path, "one")
    assert {(r.source, r.n_docs) for r in rollups.totals(spark, path).collect()} == {(None, 1)}


def test_rollups_of_two_writers_count_a_batch_once(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, path = docs.count(), shared_dir(spark)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda batch: rollups.commit(rollups.inserts(docs), path, batch), ["load", "load"]))
    counted = lambda: {r.tokenizer: r.n for r in rollups.totals(spark, path).groupBy("tokenizer").agg(F.sum("n_docs").alias("n")).collect()}
    assert set(counted().values()) == {n}
    monkeypatch.setattr(time, "time_ns", lambda: 1)  # a writer whose clock is far behind
    rollups.commit(rollups.inserts(docs), path, "load")
    assert set(counted().values()) == {n}


def test_pipeline_on_empty_tables(spark):
    path = shared_dir(spark)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    out = corpus_pipeline.run(spark, path)
    assert out.columns == corpus_pipeline.run(spark, SF).columns
    assert out.count() == 0
