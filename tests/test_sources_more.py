"""Sources, parsers and audit rows on cases that the queries lack."""

import random

import pytest
from pyspark.sql import functions as F

from quayside.functions.scratch import scratch_path
from quayside.operators import joins as J
from quayside.operators import parsing as P
from quayside.operators import windows as W
from quayside.operators.quality import reconcile_tables
from quayside.sources import files, messages


def lengths(text):
    return [(f["name"], f["start"], f["length"]) for f in files.layout_from_copybook(text)]


def test_pictures():
    assert lengths("05 A PIC XXX.\n05 B PIC 999V99.\n05 C PIC X.") == [("a", 1, 3), ("b", 4, 5), ("c", 9, 1)]
    assert lengths("05 A PIC X(2) OCCURS 3 TIMES.\n05 B PIC 9.") == [("a_1", 1, 2), ("a_2", 3, 2), ("a_3", 5, 2), ("b", 7, 1)]
    assert lengths("01 R.\n 05 FILLER PIC X.\n 05 FILLER PIC X(3).") == [("filler", 1, 1), ("filler_2", 2, 3)]
    assert lengths("01 R.\n 05 G OCCURS 2.\n  10 X PIC 9.\n  10 Y PIC XX.") == [("x_1", 1, 1), ("y_1", 2, 2), ("x_2", 4, 1), ("y_2", 5, 2)]
    names = [n for n, _, _ in lengths("01 R.\n 05 G OCCURS 2.\n  10 FILLER PIC X.\n 05 FILLER PIC X.\n 05 FILLER PIC X(3).")]
    assert len(names) == len(set(names)) == 4
    assert files.layout_from_copybook("05 A PIC 9(20).")[0]["type"] == "decimal(20,0)"


@pytest.mark.parametrize("line", ["05 A PIC 9(4) COMP-3.", "05 A PIC S9(4) BINARY.", "05 A REDEFINES B PIC X.", "05 A PIC X OCCURS 1 TO 5 DEPENDING ON N.", "05 A PIC ZZ9.99.", "05 A PIC S9 SIGN LEADING SEPARATE.", "66 A RENAMES B."])
def test_refused_pictures(line):
    with pytest.raises(ValueError):
        files.layout_from_copybook(line)


def test_punched_signs(spark):
    df = spark.createDataFrame([("0123}",), ("0123{",), ("0012J",), ("00124",), ("     ",), ("12x4A",)], "value string")
    got = files.slice_fixed_width(df, "value", files.layout_from_copybook("05 A PIC S9(3)V99."))
    assert [None if r.a is None else float(r.a) for r in got.collect()] == [-12.3, 12.3, -1.21, 1.24, None, None]


def test_sets_that_close(spark):
    text = "NM1*IL*1*OUT*SIDE~CLM*0*1~ST*837~CLM*1*2~NM1*82*1*P*Q~NM1*82*1*R*S~SE*1~CLM*2*3~ST*837~NM1*IL*1*A*B~CLM*3*x~SE*2~"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, x string")
    got = {r.claim_id: (r.patient, r.provider, r.amount) for r in messages.parse_x12_claims(rows, "k", "x").collect()}
    assert {k: v[:2] for k, v in got.items()} == {"0": ("SIDE OUT", None), "1": (None, "Q P"), "2": (None, None), "3": ("B A", None)} and got["3"][2] is None


TEXTS = [
    '{"a": 1, "b": {"c": [1, 2.5], "d": null}, "e f": "x"}', '{"a": 2.5, "b": {"c": [3], "z": true}, "g": [{"h": 1}, {"i": "s"}]}', '{"a": null, "m": 1, "n": {"o": 1}}',
    '{"m": "s", "n": "flat", "big": 123456789012345678901234, "x": 1e3}', "{}", None, '{"n": {}, "u": {}}',
]


def test_inferred_schema(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "j string")
    got, want = P.infer_json_schema(df, "j"), spark.read.json(df.where("j is not null").rdd.map(lambda r: r[0])).schema
    plain = lambda s: {f.name: f.dataType for f in s if f.name != "u"}
    assert plain(got) == plain(want)
    both = P.parse_json_column(df, "j").where("j like '%2.5]%'").first()
    assert both["a"] == 1.0 and both["b"]["c"] == [1.0, 2.5] and both["e f"] == "x"
    assert P.infer_json_schema(df.limit(0), "j").fields == [] and P.infer_json_schema(spark.createDataFrame([("no",), ("[1]",), ("5",)], "j string"), "j").fields == []
    seen = df.select(F.try_parse_json("j").alias("v")).agg(F.schema_of_variant_agg("v"))._jdf.queryExecution().toString()
    assert "Python" not in seen and "Arrow" not in seen


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(None, 1, "x"), (1, None, "y"), (2, 2, "z")], "a int, b int, v string")
    b = spark.createDataFrame([(None, 1, "x"), (1, None, "q"), (None, None, "n")], "a int, b int, v string")
    got = {(r.a, r.b, r.status) for r in reconcile_tables(a, b, ["a", "b"], 1).collect()}
    assert got == {(1, None, "different"), (2, 2, "missing"), (None, None, "extra")}


def test_audit_rows(spark):
    path = scratch_path(spark, "audited")
    df = spark.range(10).withColumn("t", F.col("id") * 2)
    row = files.run_audited(df, path, "j", watermark="t", after="7")
    assert (row["rows_read"], row["rows_written"], row["watermark_before"], row["watermark_after"], row["status"], row["error"]) == (6, 6, "7", "18", "succeeded", None)
    row = files.run_audited(df, path, "j", watermark="t", after="18", transform=lambda d: d.withColumn("n", F.lit("x")))
    assert (row["rows_read"], row["rows_written"], row["watermark_after"], row["schema_changes"]) == (0, 0, "18", ["added n string"])
    broken = df.withColumn("n", F.raise_error(F.lit("no")).cast("string"))
    row = files.run_audited(broken, path, "j", watermark="t", after="3")
    assert (row["rows_written"], row["watermark_after"], row["status"]) == (0, "3", "failed") and "no" in row["error"]
    row = files.run_audited(df.select("t", F.col("id").cast("string").alias("id")), path, "j")
    assert row["schema_changes"] == ["removed n string", "retyped id bigint string"] and row["watermark_before"] is None and row["watermark_after"] is None
    row = files.run_audited(df, path, "j")  # the table now holds files of both types
    assert (row["rows_written"], row["status"]) == (10, "succeeded")
    assert files.run_audited(df.limit(0), scratch_path(spark, "audited"), "j")["rows_written"] == 0


def test_curve(spark):
    df = spark.range(20_000).selectExpr("id % 141 AS a", "if(id % 50 = 0, null, id div 141) AS b", "'k' AS place")
    path = scratch_path(spark, "curve")
    files.write_clustered(df, path, ["a", "b"], 32)
    held = spark.read.parquet(path)
    assert held.columns == df.columns and held.exceptAll(df).count() == 0 == df.exceptAll(held).count()
    total = held.select("_metadata.file_name").distinct().count()
    for cond in ("a between 10 and 15", "b between 10 and 15"):
        assert held.where(cond).select("_metadata.file_name").distinct().count() < total / 2
    files.write_clustered(df.limit(0), scratch_path(spark, "curve"), ["a", "b"], 4)


# --- hot keys


def hot_rows(spark, n=3000):
    rng = random.Random(8)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "c"]), None if rng.random() < 0.02 else 1_700_000_000 + rng.randrange(40 * 86_400), float(rng.randrange(100)), rng.choice(["x", "y", "z"])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, k string, s long, v double, kind string")
    return df.withColumn("t", F.timestamp_seconds("s"))


@pytest.mark.parametrize("slice_hours", [None, 20, 400])
def test_velocity_of_hot_keys(spark, slice_hours):
    from pyspark.sql import Window

    df = hot_rows(spark).withColumn("at", F.lit(1))
    w = Window.partitionBy("k").orderBy(F.unix_timestamp("t"))
    want = df.withColumns({f"{what}_{h}h": f.over(w.rangeBetween(-h * 3600, 0)) for h in (1, 24, 168) for what, f in (("n", F.count("*")), ("sum", F.sum("v")))})
    got = W.velocity_features(df, "k", "t", "v", slice_hours=slice_hours)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_slices_are_even(spark):
    """The rows that windows of slices get: no slice has twice the median, though one key has a third of the rows."""
    df = spark.range(60_000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 40)) AS k", "timestamp_seconds(1700000000 + id * 60) AS t", "1.0 AS v")
    sizes = W.velocity_features(df, "k", "t", "v").groupBy("k", F.floor(F.unix_timestamp("t") / (168 * 3600))).count().where("k = 'hot'").select("count").toPandas()["count"]
    assert len(sizes) >= 6 and sorted(sizes)[-1] < 2 * sizes.median() and sizes.max() < 20_000 / 4


@pytest.mark.parametrize("as_of", [True, False])
def test_time_since_of_hot_keys(spark, as_of):
    from pyspark.sql import Window

    df = hot_rows(spark)
    t, w = F.unix_timestamp("t"), Window.partitionBy("k")
    w = w.orderBy(t).rangeBetween(Window.unboundedPreceding, 0) if as_of else w
    want = df.withColumns({f"since_{x}": (t - F.max(F.when(F.col("kind") == x, t)).over(w)) / 3600 for x in ("x", "y")})
    got = W.time_since_event(df, "k", "t", "kind", ["x", "y"], as_of, slice_hours=5)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("tolerance", [None, "3 hours"])
def test_asof_of_hot_keys(spark, tolerance):
    from pyspark.sql import Window

    df = hot_rows(spark)
    left, right = df.where("kind <> 'x'").select("id", "k", "t"), df.where("kind = 'x'").select("k", F.col("t").alias("rt"), "v")
    got = J.asof_join(left, right, ["k"], "t", "rt", ["v"], tolerance, slice_size=7200)
    joined = left.join(right.withColumnRenamed("k", "rk"), F.col("k").eqNullSafe(F.col("rk")) & (F.col("rt") <= F.col("t")), "left")
    best = joined.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("rt"), F.desc("v")))).where("n = 1")
    near = F.col("rt") >= F.col("t") - F.expr(f"INTERVAL {tolerance or '1000 days'}")
    want = best.select("id", "k", "t", F.when(near, F.col("v")).alias("v"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_keys_of_several_dimension_rows(spark):
    fact = spark.createDataFrame([(1, 5), (1, 15), (2, 5), (None, 5)], "k int, at int")
    dim = spark.createDataFrame([(1, 10, 0, 10), (1, 11, 5, 20), (1, 10, 0, 10), (2, 12, 8, 9)], "d int, s int, valid_from int, valid_to int")
    plain = J.resolve_foreign_keys(fact, dim, "k", "d", "s", "sk")
    assert sorted((r.k or 0, r.at, r.sk) for r in plain.collect()) == [(0, 5, -1), (1, 5, 10), (1, 15, 10), (2, 5, 12)]
    timed = J.resolve_foreign_keys(fact, dim, "k", "d", "s", "sk", "at")
    assert sorted((r.k or 0, r.at, r.sk) for r in timed.collect()) == [(0, 5, -1), (1, 5, 10), (1, 15, 11), (2, 5, -1)]
    assert timed.columns == ["k", "at", "sk"]


# --- upserts by bucket


def test_upsert_touches_few_buckets(spark):
    from quayside.streaming import jobs as S

    arrived, path, check = (scratch_path(spark, n) for n in ("arrived", "table", "check"))
    schema = "k long, v long, op string, seq long"
    run = lambda at: S.stream_upsert(S.stream_files(spark, arrived, schema, "parquet"), path, ["k"], ["seq"], at, buckets=256).awaitTermination()
    spark.range(1000).selectExpr("if(id = 7, null, id) AS k", "id AS v", "'u' AS op", "1L AS seq").write.parquet(arrived)
    run(check)
    files_of = lambda: {r.f: r.n for r in spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).collect()}
    before = files_of()
    spark.range(10).selectExpr("id * 100 AS k", "-id AS v", "if(id = 3, 'd', 'u') AS op", "2L AS seq").write.mode("append").parquet(arrived)
    run(check)
    after = files_of()
    assert sum(n for f, n in after.items() if f not in before) < 100
    got = {r.k: r.v for r in S.upserted(spark, path).collect()}
    assert len(got) == 999 and got[100] == -1 and 300 not in got and got[None] == 7 and got[5] == 5
    # The same batches once more, from the start: nothing is written.
    run(scratch_path(spark, "check"))
    assert files_of() == after and {r.k: r.v for r in S.upserted(spark, path).collect()} == got


