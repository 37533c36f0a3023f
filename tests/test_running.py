"""Running sums against a plain loop, and plans without a task that sees a whole group."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quayside.operators import models as M
from quayside.operators.running import running_sums


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_sums(spark, by):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice([0, 1]), rng.choice([None, 1, 2, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "file int, g string, h int, v int").repartition(5)
    got = running_sums(df, by, ["file"], {"up_to": "v"}, {"in_all": "v"}).collect()
    reached, total, want = defaultdict(int), defaultdict(int), set()
    group = lambda r: tuple({"g": r[1], "h": r[2]}[c] for c in by)
    for r in rows:
        total[group(r)] += r[3] or 0
    for r in rows:
        reached[group(r)] += r[3] or 0
        want.add((*r, reached[group(r)], total[group(r)]))
    assert {tuple(r) for r in got} == want and len(got) == 400 and got[0].__fields__ == ["file", "g", "h", "v", "up_to", "in_all"]
    assert running_sums(df.limit(0), by, ["file"], {"s": "v"}).count() == 0


def test_files_of_one_task(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    try:
        df = spark.range(100).withColumn("v", F.lit(1))
        assert sorted(r.s for r in running_sums(df, [], ["id"], {"s": "v"}).collect()) == list(range(1, 101))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def windows(df):
    return [line for line in df._jdf.queryExecution().toString().split("\n") if "Window " in line or "SinglePartition" in line]


def test_no_task_of_all_rows(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("y", (F.col("event_id") % 2).cast("int"))
    for made in (M.classification_metrics(e, "y", "value"), M.ks(e, e, ["value", "user_id"]), M.classification_metrics(e, "y", "value", by=["event_type"])):
        # Windows go by file; what is ordered over all files has a row a file.
        assert not [w for w in windows(made) if "ORDER BY" in w and "file" not in w] and made.count()


def test_null_keys_are_tested(spark):
    df = spark.createDataFrame([(None if i % 9 == 0 else i, i % 2, float(i % 7), i) for i in range(120)], "k int, y int, x double, n int")
    assert M.assign_folds(df, "k", 3).where("fold is null").count() == 0
    assert M.assign_folds(df, "k", 3, "y").columns == ["k", "y", "x", "n", "fold"]
    assert M.stratified_split(df, "y", "k").columns == ["k", "y", "x", "n", "split"]


def test_folds_are_written_once(spark, monkeypatch):
    names = []
    keep = M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, name, **o: names.append(name) or keep(df, name, **o))
    df = spark.range(200).selectExpr("id", "cast(id % 2 as int) AS y", "cast(id % 7 as double) AS x")
    got = M.hyperparameter_sweep(df, "id", "y", ["x"], "logistic", [{"regParam": 0.0}, {"regParam": 1.0}], 2).collect()
    assert names == ["folds"] and len(got) == 2 and {r.folds for r in got} == {2}
