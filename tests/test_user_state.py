"""State per key that is carried over several batches."""

from quayside.streaming import jobs


def test_users_that_the_last_batch_lacks_stay(spark, tmp_path):
    rows = [[(1, "2024-01-01", 1.0), (2, "2024-01-01", 2.0)], [(2, "2024-01-02", 3.0), (3, "2024-01-02", None)], [(3, "2024-01-03", 5.0)]]
    schema = "u long, ts string, v double"
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.stream_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "parquet", 1)
    got = jobs.run_now(jobs.user_state(stream, "u", "ts", "v", "10 days"), "update", keys=["u"])
    assert sorted((r.u, r.n, r.total) for r in got.collect()) == [(1, 1, 1.0), (2, 2, 5.0), (3, 2, 5.0)]


def test_calls_grow_with_buckets_not_with_keys(spark, tmp_path):
    rows = [[(None if u == 5 else u, f"2024-01-0{d}", None if u == 7 else u + d / 2) for u in range(d, 60)] for d in (1, 2, 3)]
    schema = "u long, ts string, v double"
    for part in [*rows, [(1, "2024-03-01", 1.0)], [(1, "2024-03-02", 1.0), (2, "2024-03-02", 4.0)], [(3, "2024-03-03", 1.0)]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.stream_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "parquet", 1)
    state = jobs.user_state(stream, "u", "ts", "v", "10 days", buckets=3)
    got = {r.u: (r.n, r.total) for r in jobs.run_now(state, "update", keys=["u"]).collect()}
    want = {None: (3, 18.0), 7: (3, 0.0)} | {u: (min(u, 3), sum(u + d / 2 for d in range(1, min(u, 3) + 1))) for u in range(3, 60) if u not in (5, 7)}
    # A state that rows meet in the batch that would end it goes on; that of user 3 had ended.
    want |= {1: (3, 3.5), 2: (3, 9.5), 3: (1, 1.0)}
    assert got == want
