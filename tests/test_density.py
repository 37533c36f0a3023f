"""Density clusters against brute force, and without pairs in crowded places."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quayside.operators import anomaly as N


def plain(points, eps, least):
    near = {i: [j for j, y in points if sum((a - b) ** 2 for a, b in zip(x, y)) <= eps * eps] for i, x in points}
    core = {i for i, js in near.items() if len(js) >= least}
    cluster = {}
    for i in sorted(core):
        if i in cluster:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in cluster:
                cluster[j] = i
                todo += [m for m in near[j] if m in core]
    return {(i, cluster.get(i, min((cluster[j] for j in near[i] if j in core), default=-1)), i in core) for i, _ in points}


@pytest.mark.parametrize("dims, n, eps, least, spread", [(1, 120, 0.03, 3, 2.0), (2, 260, 0.12, 4, 1.5), (2, 200, 0.5, 6, 2.0), (3, 220, 0.3, 5, 1.3), (2, 60, 0.1, 1, 1.0)])
def test_clusters_by_brute_force(spark, dims, n, eps, least, spread):
    rng = random.Random(dims * n)
    centres = [[rng.uniform(-spread, spread) for _ in range(dims)] for _ in range(6)]
    points = [(i, tuple(round(rng.gauss(m, 0.15), 2 if i % 3 else 6) for m in rng.choice(centres))) for i in range(n)]
    names = ["x", "y", "z"][:dims]
    df = spark.createDataFrame([(i, *x) for i, x in points] + [(-5, *[None] * dims)], ", ".join(["k long", *[f"{c} double" for c in names]])).repartition(3)
    assert {tuple(r) for r in N.dbscan(df, "k", names, eps, least).collect()} == plain(points, eps, least)


def test_crowded_cells_make_no_pairs(spark, monkeypatch):
    """100,000 points within eps of each other, and a second crowd that touches the first in a few points."""
    made = []
    keep = N.materialize

    def counted(df, name, **options):
        table = keep(df, name, **options)
        if name in ("near", "boxes"):
            made.append(table.count())
        return table

    monkeypatch.setattr(N, "materialize", counted)
    a = spark.range(100_000).select("id", (F.rand(1) * 0.7).alias("x"), (F.rand(2) * 0.7).alias("y"))
    b = spark.range(100_000, 150_000).select("id", (F.rand(3) * 0.7 + 1.6).alias("x"), (F.rand(4) * 0.7).alias("y"))
    bridge = spark.createDataFrame([(150_000 + i, 0.7 + 0.09 * i, 0.35) for i in range(10)], "id long, x double, y double")
    got = N.dbscan(a.unionByName(b).unionByName(bridge), "id", ["x", "y"], 1.0, 10)
    assert got.groupBy("cluster", "is_core").count().collect()[0]["count"] == 150_010
    assert sum(made) < 10 * 150_010
    apart = N.dbscan(a.unionByName(b.withColumn("x", F.col("x") + 0.2)), "id", ["x", "y"], 0.9, 10)
    assert {(r.cluster, r["count"]) for r in apart.groupBy("cluster").count().collect()} == {(0, 100_000), (100_000, 50_000)}


def test_no_points(spark):
    assert N.dbscan(spark.createDataFrame([], "k long, x double, y double"), "k", ["x", "y"], 1.0, 3).count() == 0
