"""Path lengths of isolation trees against hand-made ones, and scores of edge cases."""

import math

import numpy as np

from quayside.operators import anomaly


def leaves(tree):
    return [tree["n"]] if "n" in tree else leaves(tree["l"]) + leaves(tree["r"])


def test_mean_path():
    assert [anomaly._mean_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert math.isclose(anomaly._mean_path(3), 2 * (math.log(2) + 0.5772156649) - 4 / 3)


def test_paths_of_a_known_tree():
    tree = {"f": 0, "cut": 2.0, "l": {"n": 1}, "r": {"f": 1, "cut": 5.0, "l": {"n": 3}, "r": {"n": 2}}}
    got = anomaly._path(tree, np.array([[1.0, 9.0], [2.0, 4.0], [7.0, 5.0]]))
    assert np.allclose(got, [1.0, 2 + anomaly._mean_path(3), 3.0])


def test_grown_trees():
    x = np.array([[float(v), 1.0] for v in (1, 1, 2, 3, 5, 8, 8, 8)])
    for seed in range(20):
        tree = anomaly._grow(x, np.random.default_rng(seed), 0, 50)
        assert sorted(leaves(tree)) == [1, 1, 1, 2, 3]
        assert leaves(anomaly._grow(x, np.random.default_rng(seed), 0, 0)) == [8]


def test_scores_of_few_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, None)], "id int, x double")
    got = {r.id: r for r in anomaly.isolation_forest(df, ["x"], 5).collect()}
    assert sorted(got) == [1, 2, 3] and all(0 <= r.anomaly_score <= 1 for r in got.values())
    assert got[1].anomaly_score == got[2].anomaly_score
    assert anomaly.isolation_forest(df.limit(0), ["x"], 5).collect() == []
