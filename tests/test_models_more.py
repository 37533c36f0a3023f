"""Numbers within classes, forecasts with regressors, rows made for a rare class, slices of a backfill."""

import datetime

import pytest
from pyspark.sql import functions as F

from quayside.operators import history as H
from quayside.operators import models as M
from quayside.operators import timeseries as S
from quayside.operators.enrichment import number_within


def test_numbers_within_groups_and_null_is_a_group(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), (None, 5), (None, 4), ("b", 2)], "g string, k int")
    got = {(r.g, r.k): (r.n, r.size) for r in number_within(df, "g", ["k"], "n", "size").collect()}
    assert got == {("a", 1): (0, 2), ("a", 3): (1, 2), (None, 4): (0, 2), (None, 5): (1, 2), ("b", 2): (0, 1)}
    assert number_within(df.limit(0), "g", ["k"], "n").count() == 0


@pytest.fixture(scope="module")
def sales(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(s, day + datetime.timedelta(days=i), 10.0 + 2 * i + w * (i * 7 % 5), float(i * 7 % 5)) for s, w in (("a", 3.0), ("b", -4.0)) for i in range(30)]
    return spark.createDataFrame(rows, "s string, d date, y double, promo double")


def test_forecast_with_regressors(spark, sales):
    ahead = spark.createDataFrame([(s, datetime.date(2024, 1, 31), p) for s, p in (("a", 2.0), ("b", 9.0))] + [("unknown", datetime.date(2024, 1, 31), 1.0)], "s string, d date, promo double")
    got = S.forecast_series(sales, "s", "d", "y", 2, harmonics=0, regressors=["promo"], future=ahead)
    hat = {(r.s, r.d.isoformat()): r.yhat for r in got.where("is_future").collect()}
    want = {("a", "2024-01-31"): 10 + 60 + 6, ("a", "2024-02-01"): 10 + 62 + 6, ("b", "2024-01-31"): 10 + 60 - 36, ("b", "2024-02-01"): 10 + 62 - 36}
    assert hat == pytest.approx(want)
    assert not got.where("is_anomaly").count() and got.where("not is_future").count() == 60


@pytest.mark.parametrize("ratio, made", [(None, 6), (0.5, 4), (1.0, 14), (0.1, 0)])
def test_smote_rows(spark, ratio, made):
    df = spark.createDataFrame([(i, int(i >= 6), float(i), float(i * i)) for i in range(26)], "id long, y int, a double, b double")
    got = M.smote(df, "id", "y", ["a", "b"], 0, 3, ratio=ratio).collect()
    assert len(got) == made
    assert all(r.y == 0 and 0 <= r.a <= 5 and 0 <= r.b <= 25 for r in got)


@pytest.mark.parametrize("ratio, n", [(1.0, 20), (0.5, 10), (0.65, 13), (0.1, 6)])
def test_oversample_is_exact(spark, ratio, n):
    df = spark.createDataFrame([(i, int(i >= 6)) for i in range(26)], "id long, y int")
    often = [r["count"] for r in M.oversample(df, "y", ratio).where("y = 0").groupBy("id").count().collect()]
    assert sum(often) == n and len(often) == 6 and max(often) - min(often) <= 1


def test_backfill_slices(spark):
    rows = [(datetime.datetime(2024, 1, d, 5),) for d in (1, 2, 3, 4, 7, 9)] + [(None,)]
    df = spark.createDataFrame(rows, "ts timestamp")
    got = H.backfill(lambda d, by: d.groupBy(*by).agg(F.count("*").alias("n")), df, "ts", "2024-01-02", "2024-01-09", 3)
    assert {r.slice.isoformat(): r.n for r in got.collect()} == {"2024-01-02": 3, "2024-01-05": 1}


def test_facts_of_an_empty_table(spark):
    new = spark.createDataFrame([(1, 5, "x"), (2, 6, "z")], "id int, w int, k string")
    dim = spark.createDataFrame([("x", 70)], "nk string, sk int")
    for loaded, want in ((new.limit(0), {1: (70, 1), 2: (-1, 2)}), (new.where("id = 1"), {2: (-1, 1)})):
        got = H.fact_incremental(new, loaded, "w", [(dim, "k", "nk", "sk", "dim_sk")], "fact_sk", ["w"])
        assert {r.id: (r.dim_sk, r.fact_sk) for r in got.collect()} == want
