"""Removal of toxic documents where nothing was learned."""

import os
import tracemalloc
from zlib import crc32

import numpy as np
import pytest

from tallyforge.llm import toxicity


@pytest.mark.parametrize("labels", [[], [(1, None), (None, 1)]])
def test_no_usable_label_keeps_all(spark, labels):
    docs = spark.createDataFrame([(1, "some words here"), (2, None), (3, ""), (None, "more")], "doc_id long, text string")
    kept = toxicity.remove_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_the_driver_does_not_train(spark, monkeypatch):
    """A sample is learned from in a task; only its weights reach the driver."""
    texts = [(i, f"some words w{i} here" + " vile" * (i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in texts], "doc_id long, toxic int")
    pick = [(t, i % 4 == 0) for i, t in texts if crc32(str(i).encode()) % 5]
    known = toxicity.train([t for t, _ in pick], np.array([y for _, y in pick], float))
    drivers = os.getpid()
    train = toxicity.train

    def elsewhere(texts, toxic):
        assert os.getpid() != drivers
        return train(texts, toxic)

    monkeypatch.setattr(toxicity, "train", elsewhere)
    tagger = toxicity.fit_tagger(docs, labels)
    assert tagger.scale.tolist() == known.scale.tolist()
    assert tagger.model.weights.tolist() == known.model.weights.tolist()


def test_training_memory():
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(60_000)])
    texts = [" ".join(words[rng.integers(0, len(words), 400)]) + " vile" * (i % 4 == 0) for i in range(800)]
    tracemalloc.start()
    toxicity.train(texts, np.array([i % 4 == 0 for i in range(800)], float))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 33e6  # 38 MB with lists of features
