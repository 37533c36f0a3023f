"""Every vector is a query, and copies of a vector tie."""

from __future__ import annotations

import numpy as np

from quayside.jobs.catalog import QUERIES
from quayside.operators import neighbours


def test_each_vector_has_its_neighbours(spark, sf):
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    got = QUERIES["rec4_nearest_neighbours"](spark, sf).collect()
    assert {(r["query"], r["rank"]) for r in got} == {(i, n) for i in ids for n in range(1, 6)}


def test_copies_of_a_vector_tie(spark):
    vectors = np.random.default_rng(4).normal(size=(7, 24))
    df = spark.createDataFrame([(i, vectors[i % 7].tolist()) for i in range(5000)], "id long, v array<double>")
    got = {(r["query"], r["rank"]): r.neighbour for r in neighbours.nearest_neighbours(df, df, "id", "v", 3).collect()}
    assert got == {(i, n): j for i in range(5000) for n, j in enumerate([j for j in range(i % 7, 35, 7) if j != i][:3], 1)}
