"""Nearest neighbours against brute force."""

import math
import random

import numpy as np
import pytest

from quayside.operators import models as M
from quayside.operators import neighbours as B


def plain(points, k):
    out = set()
    for i, x in points:
        far = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), j) for j, y in points if j != i)
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(far[:k])}
    return out


@pytest.mark.parametrize("n, dims, cell_rows, visitors", [(1, 2, 4, 9), (3, 1, 1, 9), (150, 2, 4, 9), (300, 3, 16, 20_000), (200, 1, 2, 3)])
def test_self_neighbours(spark, n, dims, cell_rows, visitors):
    rng = random.Random(n)
    points = [(i, tuple(rng.choice([rng.random(), round(rng.random(), 1), 0.5, -3.0]) for _ in range(dims))) for i in range(n)]
    names = [f"c{d}" for d in range(dims)]
    df = spark.createDataFrame([(i, *x) for i, x in points] + [(None, *[0.0] * dims), (n, None, *[0.0] * (dims - 1))], ["id", *names]).repartition(3)
    got = {(r.query, r.neighbour, r.rank) for r in B.self_neighbours(df.unionByName(df.limit(2)), "id", names, 3, cell_rows, visitors=visitors).collect()}
    assert got == plain(points, 3)


def test_copies_make_no_pairs(spark):
    df = spark.range(60_000).selectExpr("id", "if(id % 3 = 0, 1.0, cast(id as double)) AS x", "0.0 AS y")
    got = B.self_neighbours(df, "id", ["x", "y"], 2)
    assert got.count() == 120_000
    assert {(r.query, r.neighbour, r.distance) for r in got.where("query in (0, 3, 59997, 7)").collect()} == {
        (0, 1, 0.0), (0, 3, 0.0), (3, 0, 0.0), (3, 1, 0.0), (59997, 0, 0.0), (59997, 1, 0.0), (7, 8, 1.0), (7, 5, 2.0)
    }


def test_blocks_are_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 5)).round(1)
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [])], "id long, v array<double>")
    got = B.nearest_neighbours(df.where("id % 4 = 0 or id = 7"), df, "id", "v", 4, block=5, vector_block=11).collect()
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for q in {r.query for r in got}:
        mine = sorted((r.rank, r.neighbour, r.similarity) for r in got if r.query == q)
        want = sorted(-(unit @ unit[q])[[i for i in range(90) if i != q]])[:4]
        assert [m[0] for m in mine] == [1, 2, 3, 4] and np.allclose([-m[2] for m in mine], want) and q not in {m[1] for m in mine}
    assert {r.query for r in got} == {7, *range(0, 90, 4)}
    assert B.nearest_neighbours(df.limit(0), df, "id", "v", 4).count() == B.nearest_neighbours(df, df.limit(0), "id", "v", 4).count() == 0


@pytest.mark.parametrize("crowded", [4096, 5])
def test_projections(spark, crowded):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 16))
    x = centres[rng.integers(0, 25, 3000)] + rng.normal(size=(3000, 16)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None)], "id long, v array<double>")
    some = df.where("id % 20 = 0")
    exact = {(r.query, r.neighbour) for r in B.nearest_neighbours(some, df, "id", "v", 10).collect()}
    near = B.lsh_neighbours(some, df, "id", "v", 10, crowded=crowded)
    got = {(r.query, r.neighbour) for r in near.collect()}
    assert len(exact & got) >= 0.9 * len(exact) and len(got) <= len(exact)
    assert B.lsh_neighbours(df.limit(0), df, "id", "v", 4).count() == B.lsh_neighbours(some, df.limit(0), "id", "v", 4).count() == 0


def test_smote_of_nothing(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 2.0), (2, 0, 2.0, 2.0), (3, 1, 5.0, 5.0)], "id long, y int, a double, b double")
    for ratio in (None, 2.0):
        assert M.smote(df, "id", "y", ["a", "b"], 7, ratio=ratio).count() == 0
        assert M.smote(df, "id", "y", ["a", "b"], 1, ratio=ratio).count() == 0
    assert M.oversample(df.limit(0), "y").count() == 0
    assert [(r.a, r.b) for r in M.smote(df, "id", "y", ["a", "b"], 0).where("a between 1 and 2 and b = 2").collect()]
