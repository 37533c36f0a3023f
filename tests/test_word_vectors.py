"""Word vectors of a vocabulary that the driver does not hold."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import Word2Vec

from compare import duck, rows
from quayside.jobs.catalog import QUERIES, SQL
from quayside.operators import features, word_vectors


@pytest.fixture(autouse=True)
def no_word_on_the_driver(monkeypatch):
    def held(self, df):
        raise AssertionError("the driver gets the vocabulary")

    monkeypatch.setattr(Word2Vec, "fit", held)
    monkeypatch.setattr(features, "HELD_WORDS", 0, raising=False)


@pytest.mark.parametrize("name", ["fea9_words_apart", "fea9_vectors_of_equal_words"])
def test_equals_sql_without_a_vocabulary(spark, sf, monkeypatch, name):
    monkeypatch.setattr(word_vectors, "FREQUENT", 50)
    monkeypatch.setattr(word_vectors, "BLOCK", 1000)
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck(sf).execute(SQL[name]).df())


def test_words_of_one_topic_are_near(spark):
    r = np.random.default_rng(1)
    texts = [[f"{'ab'[i % 2]}{k}" for k in r.integers(0, 15, 60)] for i in range(3000)]
    single = [[f"{t}{k}"] for t in "ab" for k in range(15)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate([*texts, *single, [], None, ["never", "a1"]])], "k int, words array<string>")
    made = {v.k: v.vector.toArray() for v in features.word2vec(df, "words", 8).collect()}
    assert len(made) == 3033 and not made[3030].any() and not made[3031].any()
    assert np.allclose(made[3032], made[3001] / 2)
    v = np.stack([made[3000 + k] for k in range(30)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sims = v @ v.T
    same = (np.arange(30) // 15)[:, None] == np.arange(30) // 15
    assert sims[same].min() > sims[~same].max()
