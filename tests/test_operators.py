"""Edge cases and properties of the library's operators."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from quayside.functions.graph import connected_components
from quayside.operators import aggregates as A
from quayside.operators import anomaly as N
from quayside.operators import cleaning as C
from quayside.operators import enrichment as E
from quayside.operators import features as X
from quayside.operators import history as H
from quayside.operators import joins as J
from quayside.operators import models as M
from quayside.operators import pii
from quayside.operators import quality as Q
from quayside.operators import recommend as R
from quayside.operators import timeseries as S
from quayside.sources import files, messages
from quayside.streaming import jobs as ST

CUSTOMERS = [
    (1, "Ann ", "ann@x.com", 10.0), (1, "Ann ", "ann@x.com", 10.0), (2, " Bob", "BOB@X.com ", 5.0), (3, "Cy", "", 7.5),
    (5, "Di", None, 0.0), (7, "Eve\t x", "eve@INVALID", -3.0), (8, "N/A", "f@y.org", None),
]


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame(CUSTOMERS, "id long, name string, email string, spend double")


def test_dedup_and_nulls(customers):
    assert C.drop_exact_duplicates(customers).count() == 6
    assert C.drop_duplicates_by_key(customers, ["id"], ["spend"]).count() == 6
    out = {r.id: r for r in C.standardize_nulls(customers).collect()}
    assert out[3].email is None and out[8].name is None and out[5].email is None
    mails = {r.id: r.email for r in C.clean_email_addresses(customers, ["email"]).collect()}
    assert mails[2] == "bob@x.com" and mails[7] is None


def test_unknown_names_are_errors(customers):
    with pytest.raises(ValueError):
        C.apply_chain(customers, [{"name": "no_such_step"}])
    with pytest.raises(ValueError):
        A.aggregate_by_key(customers, ["id"], {"spend": ["median?"]})
    with pytest.raises(ValueError):
        files.align_schema(customers, customers.select("id").schema, "strict")


def test_normalize_constant_and_empty(spark, customers):
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "k int, v double")
    assert [r.v for r in C.normalize_numeric(same, "v").collect()] == [0.0, 0.0]
    assert C.normalize_numeric(same.where("k < 0"), "v").count() == 0


def test_dense_numbers(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v")
    got = E.number_rows(df, ["v"], "n", 1).collect()
    assert sorted((r.v, r.n) for r in got) == [(i, i + 1) for i in range(1000)]
    assert E.number_rows(df.where("v < 0"), ["v"], "n").count() == 0


def test_scd2_merge_is_idempotent(spark):
    d = dt.date
    target = spark.createDataFrame([(1, "A", d(2020, 1, 1), d(9999, 12, 31), True), (2, "B", d(2020, 1, 1), d(9999, 12, 31), True), (2, "Z", d(2019, 1, 1), d(2020, 1, 1), False)], "id long, tier string, valid_from date, valid_to date, is_current boolean")
    source = spark.createDataFrame([(1, "A"), (2, "C"), (3, None)], "id long, tier string")
    once = H.scd2_merge(target, source, ["id"], ["tier"], "2024-01-01")
    assert once.count() == 5 and once.where("is_current").count() == 3
    twice = H.scd2_merge(once, source, ["id"], ["tier"], "2024-02-01")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    # null to value is a change
    again = H.scd2_merge(once, source.fillna("D"), ["id"], ["tier"], "2024-03-01")
    assert again.where("id = 3").count() == 2


def test_cdc_inverts_diff(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 2.0), (3, "c", 3.0)], "k long, s string, v double")
    new = spark.createDataFrame([(1, "a", 1.0), (3, "c", 3.0), (4, None, None)], "k long, s string, v double")
    diff = H.snapshot_diff(old, new, ["k"])
    assert {r.k: r.op for r in diff.collect()} == {1: "u", 2: "d", 4: "c"}
    assert sorted(H.apply_cdc(old, diff, ["k"], ["seq"]).collect(), key=str) == sorted(new.collect(), key=str)


def test_cdc_last_event_wins(spark):
    target = spark.createDataFrame([(1, 0.0)], "k long, v double")
    log = spark.createDataFrame([(1, 1.0, "u", 2), (1, 2.0, "d", 3), (2, 5.0, "c", 1), (2, 6.0, "u", 9), (2, 4.0, "u", 5)], "k long, v double, op string, seq long")
    assert [tuple(r) for r in H.apply_cdc(target, log, ["k"], ["seq"]).collect()] == [(2, 6.0)]


def test_asof_ties_tolerance_and_nulls(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    left = spark.createDataFrame([(1, t(5)), (1, t(1)), (2, t(5)), (1, None)], "k int, ts timestamp_ntz")
    right = spark.createDataFrame([(1, t(2), 2.0), (1, t(5), 5.0), (1, t(6), 6.0)], "k int, rts timestamp_ntz, v double")
    got = {(r.k, r.ts): r.v for r in J.asof_join(left, right, ["k"], "ts", "rts", ["v"]).collect()}
    assert got == {(1, t(5)): 5.0, (1, t(1)): None, (2, t(5)): None, (1, None): None}
    far = J.asof_join(left, right.where("v = 2"), ["k"], "ts", "rts", ["v"], "1 hour").where("v is not null")
    assert far.count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[200] == 200 and len(got) == 44
    assert connected_components(e.where("src < 0")).count() == 0


def test_scratch_tables(spark):
    from quayside.functions.scratch import discard, materialize, scratch_path

    df = spark.range(5)
    table = materialize(df, "t")
    (path,) = {f.rpartition("/")[0] for f in table.inputFiles()}
    assert table.count() == 5 and scratch_path(spark, "t") != scratch_path(spark, "t")
    discard(table, df)
    discard(table)
    assert not os.path.exists(path.removeprefix("file://")) and df.count() == 5

    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, other=None: {"spark.master": "spark://host:7077"}.get(key, other))

    with pytest.raises(ValueError):
        scratch_path(Elsewhere, "t")


def test_components_over_many_chunks(spark):
    rng = random.Random(3)
    for edges in ([(rng.randrange(300), rng.randrange(300)) for _ in range(260)], [(i, i + 1) for i in range(150)], [(9, i) for i in range(200)]):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        rng.shuffle(edges)
        for kind, f in (("long", int), ("string", "{:04d}".format))[: 1 + (len(edges) == 200)]:
            df = spark.createDataFrame([(f(a), f(b)) for a, b in edges], f"src {kind}, dst {kind}").repartition(8)
            df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
            got = {r.node: r.component for r in connected_components(df, chunk_edges=7).collect()}
            df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
            assert got == {f(x): f(find(x)) for x in root}


def test_links_are_not_squared(spark):
    df = spark.range(3000).selectExpr("id AS e", "'same' AS phone", "concat('m', id % 1000) AS mail")
    got = N.linked_entities(df, "e", ["phone", "mail"])
    assert got.count() == 3000 and got.agg(F.max("group")).first()[0] == 0


def test_dbscan(spark):
    pts = [(i, 0.0 + i * 0.01, 0.0) for i in range(20)] + [(100 + i, 5.0, 5.0 + i * 0.01) for i in range(20)] + [(999, 50.0, 50.0)]
    got = {r.k: r.cluster for r in N.dbscan(spark.createDataFrame(pts, "k long, x double, y double"), "k", ["x", "y"], 0.05, 3).collect()}
    assert got[999] == -1 and {got[i] for i in range(20)} == {0} and {got[100 + i] for i in range(20)} == {100}


def test_isolation_forest_finds_the_odd_one(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 10 AS double) AS x", "cast(id % 7 AS double) AS y").unionByName(spark.createDataFrame([(9999, 500.0, 500.0)], "id long, x double, y double"))
    top = N.isolation_forest(df, ["x", "y"], 20).orderBy(F.desc("anomaly_score")).first()
    assert top.id == 9999 and top.is_anomaly


def test_geohash_known_cells(spark):
    df = spark.createDataFrame([(57.64911, 10.40744), (-25.382708, -49.265506), (None, 1.0)], "lat double, lon double")
    got = [r[0] for r in df.select(X.geohash(F.col("lat"), F.col("lon"), 8)).collect()]
    assert got == ["u4pruydq", "6gkzwgjz", None]


def test_masking_keeps_length(customers):
    got = pii.mask_column(customers, ["email"], visible=3).where("email is not null")
    before = sorted(len(r[2]) for r in CUSTOMERS if r[2] is not None)
    assert sorted(len(r.email) for r in got.collect()) == before


def test_split_adds_up_and_null_is_invalid(customers):
    flagged = Q.add_validation_flags(customers, {"spent": "spend > 1", "mail": "email LIKE '%@%'"})
    parts = Q.split_valid_invalid(flagged)
    assert parts["valid"].count() + parts["invalid"].count() == len(CUSTOMERS) and parts["valid"].count() == 3
    assert Q.enforce_contract(customers, columns={"id": "string"}, min_rows=10)["breaches"] == ["id: bigint instead of string", "7 rows, fewer than 10"]


def test_folds_partition_rows(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS y")
    folds = M.assign_folds(df, "id", 4, "y").groupBy("y", "fold").count().collect()
    assert sum(r["count"] for r in folds) == 1000 and max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 1


def test_models_meet_thresholds(spark):
    df = spark.range(1000).selectExpr("id", "cast((id * 37) % 100 AS double) AS a", "cast((id * 61) % 100 AS double) AS b").withColumn("y", (F.col("a") + F.col("b") > 100).cast("int"))
    m = M.train(df.where("id % 5 <> 0"), "y", ["a", "b"], "forest", numTrees=10)
    got = M.classification_metrics(M.batch_score(df.where("id % 5 = 0"), m, ["a", "b"]), "y", "score").first()
    assert got.accuracy > 0.8 and got.auc > 0.9
    lin = M.train(df.withColumn("z", 2 * F.col("a") + 3 * F.col("b")), "z", ["a", "b"], "linear")
    r = M.regression_metrics(lin.transform(X.assemble(df.withColumn("z", 2 * F.col("a") + 3 * F.col("b")), ["a", "b"])), "z", "prediction").first()
    assert r.r2 > 0.99


def test_forecast_follows_a_line(spark):
    df = spark.range(60).selectExpr("'s' AS s", "date_add(DATE '2024-01-01', cast(id AS int)) AS d", "cast(id AS double) AS y")
    got = S.forecast_series(df, "s", "d", "y", 3).where("is_future").orderBy("d").collect()
    assert [round(r.yhat, 3) for r in got] == [60.0, 61.0, 62.0]


def test_neighbours_exact(spark):
    df = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    got = R.nearest_neighbours(df.where("vec_id < 3"), df, "vec_id", "embedding", 4, block=2)
    assert got.count() == 12 and got.where("query = neighbour").count() == 0


def test_files(spark, tmp_path):
    for day, v in (("2024-01-01", 1), ("2024-01-02", 2)):
        (tmp_path / f"drop_{day}.csv").write_text(f"a|b\n{v}|x\n")
    got = files.read_daily_drop(spark, f"file://{tmp_path}", "csv", "2024-01-01", "a int, b string", header=True, delimiter="|").collect()
    assert [(r.a, str(r.file_date)) for r in got] == [(2, "2024-01-02")]
    assert files.read_modified_since(spark, f"file://{tmp_path}", "csv", "2000-01-01T00:00:00", "a int, b string").count() == 4


def test_jdbc_round_trip(spark):
    url, driver = "jdbc:derby:memory:quayside;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(100).selectExpr("id AS ID", "id * 2 AS V").write.option("quoteIdentifiers", "true").jdbc(url, "t", mode="overwrite", properties={"driver": driver})
    whole = files.read_jdbc(spark, url, "t", driver, "ID", 0, 100, 4)
    assert whole.count() == 100 and whole.rdd.getNumPartitions() == 4
    assert files.read_jdbc(spark, url, "t", driver, predicates=['"ID" < 50', '"ID" >= 50']).count() == 100


def test_messages(spark):
    line = "8=FIX.4.4\x0135=D\x0111=A1\x0155=IBM\x0154=1\x019999=z"
    got = messages.parse_fix_log(spark.createDataFrame([(line,), (None,), ("35=0",)], "l string"), "l", ["D"], ["9999"]).first()
    assert (got.ClOrdID, got.Symbol, got.Tag9999) == ("A1", "IBM", "z")
    assert files.layout_from_copybook("  05 BAL PIC 9(10)V99.")[0] == {"name": "bal", "start": 1, "length": 12, "type": "decimal(12,2)", "scale": 2}


def test_late_rows_are_split(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"id": 1, "ts": "2024-01-02T00:00:00"}\n')
    schema = "id long, ts timestamp"
    seen = {"good": [], "late": []}
    put = lambda k: lambda df, _: seen[k].extend(r.id for r in df.collect())
    ST.split_late(ST.stream_files(spark, f"file://{src}", schema), "ts", 3600, put("good"), put("late"), f"file://{tmp_path}/c").awaitTermination()
    (src / "b.json").write_text('{"id": 2, "ts": "2024-01-01T00:00:00"}\n{"id": 3, "ts": "2024-01-02T01:00:00"}\n')
    ST.split_late(ST.stream_files(spark, f"file://{src}", schema), "ts", 3600, put("good"), put("late"), f"file://{tmp_path}/c").awaitTermination()
    assert sorted(seen["good"]) == [1, 3] and seen["late"] == [2]


def test_streams_refuse_steps_over_rows(spark, tmp_path):
    s = ST.stream_files(spark, f"file://{tmp_path}", "id long")
    with pytest.raises(ValueError):
        ST.stream_transform(s, [{"name": "drop_exact_duplicates"}])


def test_plans(spark):
    df = spark.range(100).selectExpr("id AS k", "id % 3 AS v", "id AS seq", "'u' AS op")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    numbered = plan(E.number_rows(df, ["v"], "n"))
    assert numbered.count("SinglePartition") == 1 and "Window [coalesce" not in numbered.split("SinglePartition")[1]  # the list of files alone
    assert "BatchEvalPython" not in plan(H.apply_cdc(df.select("k", "v"), df, ["k"], ["seq"]))


def test_repeated_tags_and_fields(spark):
    from quayside.sources import messages as M

    fix = M.SOH.join(["8=FIX.4.4", "35=8", "31=9.5", "32=100", "448=A", "448=B=C", "junk", "58=", "10=001"])
    (r,) = M.parse_fix_log(spark.createDataFrame([(1, fix), (2, None)], "k int, line string"), "line", ["8"], ["448"]).collect()
    assert (r.LastPx, r.LastQty, r.Tag448, r.CheckSum, r.Symbol) == ("9.5", "100", "B=C", "001", None)
    assert [tuple(x) for x in r.fields if x.name.startswith("Tag")] == [("Tag448", "A"), ("Tag448", "B=C"), ("Tag58", "")]
    mt = "{1:F01X}{2:I940Y}{4:\n:20:REF\n:61:first\n:61:second\n:86:a\nb\n-}"
    (r,) = M.parse_swift_mt(spark.createDataFrame([(mt,)], "m string"), "m").collect()
    assert r.message_type == "940" and r.reference == "REF" and [tuple(x) for x in r.fields] == [("reference", "REF"), ("Field61", "first"), ("Field61", "second"), ("Field86", "a b")]


def test_quantiles(spark):
    from quayside.operators.quantiles import long_values, quantiles

    rng = random.Random(2)
    df = spark.createDataFrame([(rng.gauss(0, 1), float(rng.randrange(4)), None) for _ in range(501)] + [(None, 1.0, None)], "a double, `b.c` double, none double").repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    got = {(r.column, r.share): r.q for r in quantiles(long_values(df, df.columns), shares).collect()}
    for c in ("a", "b.c"):
        want = df.agg(F.percentile(F.col(f"`{c}`"), F.array(*map(F.lit, shares)))).first()[0]
        assert [got[c, s] for s in shares] == pytest.approx(want, rel=1e-12)
    assert len(got) == 12


def test_null_keys_merge(spark):
    rows = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    new = spark.createDataFrame([(None, 5), (3, 3)], "k int, v int")
    once = H.merge_upsert(rows, new, ["k"])
    assert sorted(map(str, H.merge_upsert(once, new, ["k"]).collect())) == sorted(map(str, once.collect())) and once.count() == 3
