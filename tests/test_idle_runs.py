"""Idle runs, against a plain loop over each key's rows."""

from datetime import datetime, timedelta

from quayside.functions.scratch import scratch_path
from quayside.streaming import jobs

DAY0 = datetime(2024, 1, 1)
SCHEMA = "u long, ts timestamp, v double"


def told(spark, batches, **options):
    path, out, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    for rows in batches:
        spark.createDataFrame([(u, DAY0 + timedelta(hours=h), v) for u, h, v in rows], SCHEMA).repartition(2).write.mode("append").parquet(path)
        with jobs.with_rocksdb(spark):
            s = jobs.idle_runs(jobs.stream_files(spark, path, spark.createDataFrame([], SCHEMA).schema, "parquet"), "u", "ts", "v", **options)
            s.writeStream.foreachBatch(jobs.by_batch(out)).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    ms = lambda h: int((DAY0 - datetime(1970, 1, 1) + timedelta(hours=h)).total_seconds() * 1000)
    return sorted(((r.u, (r.last_ms - ms(0)) / 3600000, r.n, r.total) for r in spark.read.parquet(out).collect()), key=str)


def want(batches):
    runs, mark = [], max(h for b in batches for _, h, _ in b)
    for k in {u for b in batches for u, _, _ in b}:
        run = None
        for h, v in sorted((h, v or 0.0) for b in batches for u, h, v in b if u == k):
            if run and h - run[1] >= 24:
                runs.append(tuple(run))
                run = None
            run = [k, h, (run[2] if run else 0) + 1, (run[3] if run else 0.0) + v]
        if run[1] + 24 <= mark:
            runs.append(tuple(run))
    return sorted(runs, key=str)


def test_a_run_is_told_when_the_watermark_reaches_its_end(spark):
    batches = [[(1, 0, 1.0), (2, 1, 2.0)], [(3, 24, 4.0)]]
    assert told(spark, batches) == [(1, 0.0, 1, 1.0)] == want(batches)


def test_runs_of_many_keys_in_few_buckets(spark):
    batches = [[(None if u == 5 else u, d * 30 + u * 7 % 29 + 0.25 * i, None if u == 7 else u + i / 2) for u in range(20) for i in range(3) if (u + d) % 3] for d in range(3)]
    got = told(spark, batches, buckets=2)
    assert got == want(batches) and len(got) > 20 and any(k is None for k, *_ in got)


def test_late_rows_belong_to_the_open_run(spark):
    batches = [[(1, 60, 1.0), (2, 30, 1.0)], [(1, 20, 2.0), (2, 62, 4.0)], [(3, 200, 1.0)]]
    assert told(spark, batches, delay="50 hours", buckets=1) == [(1, 60.0, 2, 3.0), (2, 30.0, 1, 1.0), (2, 62.0, 1, 4.0)]
