"""Steps that have to stay bounded as tables grow."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import Word2Vec
from pyspark.sql import functions as F

from quayside.operators import features, neighbours, quality, recommend
from quayside.sources import messages


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_vectors_are_trained_by_all_tasks(spark, monkeypatch):
    seen, fit = [], Word2Vec.fit
    monkeypatch.setattr(Word2Vec, "fit", lambda self, df: seen.append(self.getNumPartitions()) or fit(self, df))
    df = spark.createDataFrame([(["a", "b", "a", "c"],)] * 40, "words array<string>")
    assert features.word2vec(df, "words", 4).count() == 40
    assert seen == [spark.sparkContext.defaultParallelism] and seen[0] > 1


def test_word_vectors_are_trained_on_written_tokens(spark, monkeypatch):
    seen, fit = [], Word2Vec.fit
    monkeypatch.setattr(Word2Vec, "fit", lambda self, df: seen.append((plan(df), df.rdd.getNumPartitions())) or fit(self, df))
    df = features.words(spark.createDataFrame([("a b a c",)] * 40, "text string").coalesce(1), "text")
    made = features.word2vec(df, "words", 4)
    assert {len(r.vector) for r in made.collect()} == {4} and made.columns == ["text", "words", "vector"]
    assert "FileScan parquet" in seen[0][0] and "split" not in seen[0][0] and seen[0][1] > 1


def test_claims_are_read_inside_their_rows(spark):
    rows = [(1, "ST*837~NM1*IL*1*DOE*ANN~CLM*A*5***11:B:1~CLM*B*x~NM1*82*1*HOUSE*GREG~NM1*82*1*LATE*LEE~SE*1~CLM*C*7"), (1, "CLM*D*1.5~NM1*82*1*FOX*SAM"), (2, None), (3, "ST*837~SE*1")]
    made = messages.parse_x12_claims(spark.createDataFrame(rows, "k int, x string"), "k", "x")
    assert "Exchange" not in plan(made)
    got = sorted((r.k, r.claim_id, r.amount and float(r.amount), r.place, r.patient, r.provider) for r in made.collect())
    assert got == [(1, "A", 5.0, "11", "ANN DOE", None), (1, "B", None, None, "ANN DOE", "GREG HOUSE"), (1, "C", 7.0, None, None, None), (1, "D", 1.5, None, None, "SAM FOX")]


def test_buckets_that_differ_are_broadcast(spark):
    s = spark.range(100).withColumn("v", F.col("id"))
    t = s.withColumn("v", F.when(F.col("id") == 7, -1).otherwise(F.col("v")))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = quality.reconcile_tables(s, t, ["id"], buckets=1)
        assert plan(made).count("BroadcastHashJoin") >= 2
        assert [tuple(r) for r in made.collect()] == [(7, "different")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_topics_are_fitted_on_written_counts(spark, monkeypatch):
    seen, fit = [], LDA.fit
    monkeypatch.setattr(LDA, "fit", lambda self, df: seen.append(plan(df)) or fit(self, df))
    df = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["c", "d"]) for i in range(20)], "k int, words array<string>")
    assert recommend.topics(df, "k", "words", 2, 10, 2, share=1.0).count() == 20
    assert "FileScan parquet" in seen[0] and "UDF" not in seen[0]


@pytest.mark.parametrize("scale", [0.0, 1.0])
def test_largest_products_by_blocks(spark, scale):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(300, 4)).astype(np.float32), (r.normal(size=(9000, 4)) * np.exp(scale * r.normal(size=(9000, 1)))).astype(np.float32)
    x[0] = 0
    place, best = recommend._largest(x, y, 5)
    want = np.sort(x @ y.T, axis=1)[:, ::-1][:, :5]
    assert np.allclose(best, want, atol=1e-5)
    assert np.allclose(np.take_along_axis(x @ y.T, place, 1), best, atol=1e-5)
    left, right = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(f)], "id int, features array<float>") for f in (x[:40], y[:500])]
    got = recommend._best_products(left, right, 3, rows=64)
    assert "Recommend" not in plan(got)
    score = np.zeros((40, 3))
    for b in got.collect():
        score[b.a, b["rank"] - 1] = b.score
    assert np.allclose(score, np.sort(x[:40] @ y[:500].T, axis=1)[:, ::-1][:, :3], atol=1e-5)
    few = {(b.a, b["rank"]) for b in recommend._best_products(left, right.limit(2), 3).collect()}
    assert len(few) == 80


def test_few_products_are_sorted(monkeypatch):
    sorted_, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_.append(len(keys[0])) or lexsort(keys))
    r = np.random.default_rng(4)
    x, y = r.normal(size=(256, 8)).astype(np.float32), r.normal(size=(4000, 8)).astype(np.float32)
    _, best = recommend._largest(x, y, 5)
    assert np.allclose(best, np.sort(x @ y.T, axis=1)[:, ::-1][:, :5], atol=1e-5)
    assert sum(sorted_) < 256 * 100


def test_scores_of_users_are_no_table(spark):
    r = np.random.default_rng(7)
    seen = [(u, i, float(1 + i % 3) if ((u or 0) + i) % 5 else None) for u in [None, *range(40)] for i in sorted(set(r.integers(0, 30, 6).tolist()))]
    df = spark.createDataFrame([(u, f"p{i:02}", "2024-01-01", w) for u, i, w in seen], "u long, i string, ts string, w double")
    users = sorted({u for u, _, _ in seen}, key=str)
    x, a = np.zeros((41, 30)), np.full((41, 30), np.nan)
    for u, i, w in seen:
        x[users.index(u), i] = 1
        a[users.index(u), i] = np.nan if w is None else w
    pairs = x[: users.index(None)].T @ x[: users.index(None)]  # None comes last
    n = x.sum(0)
    sim = pairs / np.maximum(1, n[:, None] + n[None, :] - pairs)
    want = {}
    for p, u in enumerate(users):
        own = np.flatnonzero(x[p])
        for j in range(30):
            if pairs[own, j].any() and (u is None or not x[p, j]):
                known = own[~np.isnan(a[p, own]) & (pairs[own, j] > 0)]
                want[u, f"p{j:02}"] = float(a[p, known] @ sim[known, j]) if len(known) else None
    made = recommend.sar(df, "u", "i", "ts", "w", "2024-01-01", k=50, rows=16, links=64)
    assert "FlatMapCoGroups" in plan(made)
    got = {(r.u, r.i): r.score for r in made.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] is None if v is None else abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_buckets_grow_where_recall_would_fall(spark):
    vectors = np.random.default_rng(2).normal(size=(6000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
    some = df.where("id % 20 = 0")
    near = neighbours.lsh_neighbours(some, df, "id", "v", 10, tables=3, probes=3, bucket_rows=4)
    exact = neighbours.nearest_neighbours(some, df, "id", "v", 10)
    assert near.select("query", "neighbour").intersect(exact.select("query", "neighbour")).count() >= 0.9 * exact.count()


def test_all_words_are_counted(spark):
    df = spark.createDataFrame([(i, [f"w{j}" for j in range(i, i + 12000)]) for i in range(2)], "k int, words array<string>")
    for vocabulary, want in ((10000, 10000), (None, 11999)):
        made = features.count_vectorize(df, "words", vocabulary, 2.0)
        assert {len(r.counts.indices) for r in made.collect()} == {want}


def test_similarities_are_held_in_slices(spark, monkeypatch):
    vectors = np.random.default_rng(5).normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>").coalesce(1)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -np.inf)
    got = {(r["query"], r["rank"]): r.neighbour for r in neighbours.nearest_neighbours(df, df, "id", "v", 3).collect()}
    want = np.argsort(-sims, axis=1, kind="stable")[:, :3]
    assert got == {(i, j + 1): want[i, j] for i in range(600) for j in range(3)}
