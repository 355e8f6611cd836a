from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from treeloom.llm import toxicity
from treeloom.llm.boosting import BoostedTrees, Isotonic

SF = "/root/testdata/sf0.01"


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(4)
    p = rng.random(60)
    y = (rng.random(60) < p).astype(float)
    f = Isotonic().fit(p, y)
    values = f(np.sort(p))
    assert (np.diff(values) >= -1e-12).all()
    # The least squares fit of a nondecreasing sequence: max over left of min over right of means.
    s = y[np.argsort(p, kind="stable")]
    want = [max(min(s[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    blocks = Isotonic().fit(p, y)
    assert np.allclose(sorted(set(np.round(want, 9))), sorted(set(np.round(blocks.y, 9))))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(5)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = BoostedTrees(trees=40).fit(x[:600], y[:600]).probability(x[600:])
    assert ((p > 0.5) == y[600:]).mean() > 0.9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").toPandas()
    assert got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    test = got[got.held_out]
    hit = ((test.predicted == 1) & (test.toxic == 1)).sum()
    assert hit / (test.toxic == 1).sum() >= 0.7 and hit / (test.predicted == 1).sum() >= 0.6
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(docs, toxicity.train(docs, flipped)).toPandas().sort_values("doc_id")
    first = toxicity.score(docs, model).toPandas().sort_values("doc_id")
    assert np.allclose(again.score, first.score)


def test_odd_rows(docs, none):
    model = toxicity.Model({}, None, None)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.select("doc_id").distinct().count() and got[18]["predicted"] == 1 and got[0]["predicted"] == 0
    assert toxicity.score(none, model).count() == 0 and toxicity.drop_toxic(none, model).count() == 0
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and 18 not in {r["doc_id"] for r in left.collect()}


def test_few_labels(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).trees is None
    assert toxicity.train(docs, labels.filter("false")).trees is None


def test_capitals_count_alike_at_every_length():
    from treeloom.llm.toxicity import FEATURES, Featurizer

    rate = [f for f in Featurizer({}).matrix(["\U0001d400" * n for n in (100, 500)])[:, 8]]
    assert rate == [1.0, 1.0] and len(FEATURES) > 8


def test_repeated_ids_do_not_multiply_training_rows(spark):
    from treeloom.llm.toxicity import training_rows

    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    assert training_rows(docs, labels, "toxic", 100).count() <= 5
