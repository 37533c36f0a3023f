"""Structured Streaming forms of the library's jobs."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quayside.functions.scratch import discard, materialize, scratch_path
from quayside.operators.history import compact_changes
from quayside.sources.files import overwrite_partitions


def stream_files(spark: SparkSession, path: str, schema, kind: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(kind)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)


def stream_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None, kind: str = "parquet") -> StreamingQuery:
    """Append to files; ``trigger`` is availableNow by default."""
    return df.writeStream.format(kind).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)


def stream_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count()


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """The time as a timestamp (a watermark refuses other kinds), with a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def windowed(df: DataFrame, ts: str, keys: list[str], value: str, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Tumbling or sliding windows: count and sum. The same for a stream and a batch."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = _timed(df, ts, delay).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, keys: list[str], value: str, gap: str, delay: str = "1 hour") -> DataFrame:
    out = _timed(df, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n", "total")


def dedupe_stream(df: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    return _timed(df, ts, delay).dropDuplicatesWithinWatermark(keys)


def dedupe_state(df: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """One row for each key and time; rows behind the watermark are dropped, and counted by the stream."""
    return _timed(df, ts, delay).dropDuplicates([*keys, ts])


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch as a partition ``batch`` of a table, in place of what an earlier run of it wrote."""
    return lambda df, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def split_late(df: DataFrame, ts: str, delay_seconds: int, on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Batches split against the latest time seen before each batch; late rows go to ``late``. The time is read from the
    stored maximum of earlier batches, so a batch that runs again is split as before. The sinks get the number of the batch,
    by which they overwrite what an earlier run of it wrote (see ``by_batch``)."""
    marks = f"{checkpoint}/latest"

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        seen = None
        if number:
            try:
                seen = spark.read.schema("batch long, latest long").parquet(marks).where(F.col("batch") < number).agg(F.max("latest")).first()[0]
            except Exception as e:  # no batch had a row yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        t = F.unix_timestamp(F.col(ts).cast("timestamp"))
        is_late = F.lit(False) if seen is None else F.coalesce(t < seen - delay_seconds, F.lit(False))
        on_time(batch.where(~is_late), number)
        late(batch.where(is_late), number)
        batch.agg(F.max(t).alias("latest")).where("latest is not null").write.mode("overwrite").parquet(f"{marks}/batch={number}")
        batch.unpersist()

    return df.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True).start()


_OVER_ROWS = {"row_number", "drop_exact_duplicates", "drop_duplicates_by_key", "remove_outliers_iqr", "normalize_numeric"}


def stream_transform(df: DataFrame, steps: list[dict]) -> DataFrame:
    """A cleaning chain on a stream; steps that look at other rows are refused."""
    from quayside.operators.cleaning import apply_chain

    bad = [s["name"] for s in steps if s["name"] in _OVER_ROWS]
    if df.isStreaming and bad:
        raise ValueError(f"steps that look at other rows cannot run on a stream: {bad}")
    return apply_chain(df, steps)


def stream_enrich(df: DataFrame, static: DataFrame, on: list[str]) -> DataFrame:
    return df.join(static, on, "left")


def interval_join(a: DataFrame, b: DataFrame, key: str, a_ts: str, b_ts: str, within: str, delay: str = "1 hour") -> DataFrame:
    """Rows of two streams with one key whose times lie within an interval; both have watermarks, so state is bounded.

    Time is cut into slices of eight intervals. A row of ``b`` is in its own slice, a row of ``a`` in the one or two that its
    interval touches: a pair meets once, in the slice of ``b``, and a row meets the rows of its slice, not all of its key.
    """
    reach = F.expr(f"INTERVAL {within}")
    width = F.greatest(F.lit(1), 8 * F.unix_micros(F.timestamp_seconds(F.lit(0)) + reach))
    part = lambda t: F.floor(F.unix_micros(t) / width).cast("long")
    x, y = _timed(a, a_ts, delay), _timed(b.withColumnRenamed(key, f"_{key}"), b_ts, delay)
    x = x.withColumn("_slice", F.explode(F.sequence(part(F.col(a_ts)), part(F.col(a_ts) + reach))))
    y = y.withColumn("_in", part(F.col(b_ts)))
    near = (F.col(b_ts) >= F.col(a_ts)) & (F.col(b_ts) <= F.col(a_ts) + reach)
    return x.join(y, (F.col(key) == F.col(f"_{key}")) & (F.col("_slice") == F.col("_in")) & near).drop(f"_{key}", "_slice", "_in")


def stream_upsert(df: DataFrame, path: str, keys: list[str], seq: list[str], checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep the last change per key in a table of ``buckets`` folders by a hash of the key; ``upserted`` reads the rows that
    are not deleted.

    Deletes stay as marks, so batches may come in any order of ``seq``. A batch reads and overwrites only the buckets that its
    keys fall into: choose so many that a batch's keys touch few of them. Each row has the number of the batch that wrote
    its bucket last, so a batch that runs again passes over the buckets that it had finished and mends the others.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Hashed as a struct, null keys have a bucket like any other.
        dealt = materialize(batch.withColumn("_bucket", F.pmod(F.xxhash64(F.struct(*keys)), F.lit(buckets)).cast("int")), "changes")
        touched = [r[0] for r in dealt.select("_bucket").distinct().collect()]  # at most as many as there are buckets
        schema = StructType([*batch.schema.fields, StructField("_batch", LongType()), StructField("_bucket", IntegerType())])
        try:
            held = spark.read.schema(schema).parquet(path).where(F.col("_bucket").isin(touched))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            held = spark.createDataFrame([], schema)
        done = [r[0] for r in held.where(F.col("_batch") >= number).select("_bucket").distinct().collect()]
        every = held.drop("_batch").unionByName(dealt).where(~F.col("_bucket").isin(done))
        # Written aside first, as the table that is read is the one that is written.
        merged = materialize(compact_changes(every, ["_bucket", *keys], seq).withColumn("_batch", F.lit(number)), "merged")
        overwrite_partitions(merged.repartition("_bucket"), path, ["_bucket"])
        discard(dealt, merged)

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, path: str, op: str = "op") -> DataFrame:
    rows = spark.read.parquet(path).drop("_batch", "_bucket")
    return rows.where(~F.coalesce(F.col(op).isin("d", "delete", "D", "DELETE"), F.lit(False)))


def stream_score(df: DataFrame, column: str, schema: str, model, columns: list[str]) -> DataFrame:
    """JSON payloads to features to predictions."""
    from quayside.operators.models import batch_score

    rows = df.select(F.from_json(F.col(column).cast("string"), schema).alias("r")).select("r.*")
    return batch_score(rows.dropna(subset=columns), model, columns)


def user_state(df: DataFrame, key: str, ts: str, value: str, timeout: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """Running count, sum and last time per key, with a state that goes after ``timeout`` of event time. Stateful.

    A state holds the keys of one of ``buckets`` by hash, as a call of Python costs far more than a key's rows: calls grow
    with the buckets, not with the keys.
    """

    def update(_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        keys = {k: tuple(rest) for k, *rest in zip(*state.get)} if state.exists else {}
        told = []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            for k, part in rows.groupby("k", dropna=False, sort=False).agg(n=("v", "size"), total=("v", "sum"), last=("s", "max")).iterrows() if len(rows) else ():
                k = None if pd.isna(k) else k.item() if hasattr(k, "item") else k
                n, total, last, _due = keys.get(k, (0, 0.0, 0, 0))
                n, total, last = n + int(part["n"]), total + float(part["total"]), max(last, 0 if pd.isna(part["last"]) else int(part["last"]))
                keys[k] = (n, total, last, max(last * 1000, mark) + hold)
                told.append((k, n, total, last))
        touched = {k for k, *_ in told}
        keys = {k: v for k, v in keys.items() if k in touched or v[3] >= mark}
        if keys:
            state.update(tuple([list(keys), *(list(c) for c in zip(*keys.values()))]))
            state.setTimeoutTimestamp(max(min(v[3] for v in keys.values()), mark + 1))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=[key, "n", "total", "last_seen"])

    hold = int(pd.Timedelta(timeout).total_seconds() * 1000)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(ts).cast("timestamp").alias("t"), F.col(value).cast("double").alias("v")).withWatermark("t", timeout)
    # Null keys are a group of their own, so whole numbers stay whole in the others.
    rows = rows.select("k", "t", F.unix_timestamp("t").alias("s"), "v", F.when(F.col("k").isNotNull(), F.pmod(F.xxhash64("k"), F.lit(buckets))).alias("bucket"))
    held = f"keys array<{kind}>, n array<long>, total array<double>, last array<long>, due array<long>"
    return rows.groupBy("bucket").applyInPandasWithState(update, f"{key} {kind}, n long, total double, last_seen long", held, "update", GroupStateTimeout.EventTimeTimeout)


class _Idle(StatefulProcessor):
    """Closes a key's run of rows once no row has come for ``hold`` milliseconds of event time. A state holds the open runs of
    the keys of a bucket, with one timer for the first that may end."""

    def __init__(self, hold: int):
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")
        self.runs = handle.getListState("runs", "key string, last_ms long, n long, total double")

    def _hold(self, runs: pd.DataFrame) -> None:
        """Keep the open runs, and have the timer go off once the watermark reaches the first of their ends."""
        old = self.timer.get()[0] if self.timer.exists() else None
        new = int(runs["last_ms"].min()) + self.hold if len(runs) else None
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is None:
                self.timer.clear()
            else:
                self.handle.registerTimer(new)
                self.timer.update((new,))
        if len(runs):
            self.runs.put(list(zip(*(runs[c].tolist() for c in _RUN))))
        else:
            self.runs.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        got = pd.DataFrame({"key": got["key"], "last_ms": got["at_ms"].astype("int64"), "n": 1, "total": got["v"].fillna(0.0).astype("float64")})
        held = list(self.runs.get()) if self.runs.exists() else []
        every = pd.concat([pd.DataFrame(held, columns=_RUN), got], ignore_index=True) if held else got
        code, _ = pd.factorize(every["key"])
        at = every["last_ms"].to_numpy()
        # A row behind its key's open run belongs to it.
        least = np.full(code.max() + 1, np.iinfo(np.int64).min)
        least[code[: len(held)]] = at[: len(held)]
        at = np.maximum(at, least[code])
        # All rows of the batch are put in order: a run can have ended between two of them.
        order = np.lexsort((at, code))
        code, at = code[order], at[order]
        same = code[1:] == code[:-1]
        first = np.flatnonzero(np.append(True, ~same | (at[1:] - at[:-1] >= self.hold)))
        last = np.append(first[1:], len(at)) - 1
        made = every.iloc[order[first]].assign(
            last_ms=at[last], n=np.add.reduceat(every["n"].to_numpy()[order], first), total=np.add.reduceat(every["total"].to_numpy()[order], first)
        )
        open_ = np.append(code[first][1:] != code[first][:-1], True)
        self._hold(made[open_])
        if not open_.all():
            yield made[~open_].assign(bucket=key[0])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs = pd.DataFrame(list(self.runs.get()) if self.runs.exists() else [], columns=_RUN)
        ended = (runs["last_ms"] + self.hold <= timerValues.getCurrentWatermarkInMs()).to_numpy(bool)
        self._hold(runs[~ended])
        if ended.any():
            yield runs[ended].assign(bucket=key[0])

    def close(self) -> None:
        pass


_RUN = ["key", "last_ms", "n", "total"]


def idle_runs(df: DataFrame, key: str, ts: str, value: str, idle: str = "1 day", delay: str = "0 seconds", buckets: int = 1024) -> DataFrame:
    """``key, last_ms, n, total`` once for each run of a key's rows after which none came for ``idle`` of event time.

    Value and list state with a timer for each of ``buckets`` of the keys by hash: calls of Python grow with the buckets, not
    with the keys. A run that is told leaves no state. Timers go by the watermark, so a run is told when the watermark
    reaches its end, or at once if the next batch holds a row beyond it. The stream needs the RocksDB state store: see
    ``with_rocksdb``.
    """
    hold = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = df.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("t"), F.col(value).cast("double").alias("v")).withWatermark("t", delay)
    # Null keys have a bucket of their own. Keys travel as strings: pandas makes whole numbers beside a null inexact.
    rows = rows.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "t", F.unix_millis("t").alias("at_ms"), "v", F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets))).alias("bucket"))
    kind = df.schema[key].dataType.simpleString()
    told = rows.groupBy("bucket").transformWithStateInPandas(_Idle(hold), "bucket long, key string, last_ms long, n long, total double", "Append", "EventTime")
    return told.select(F.when(F.col("bucket") >= 0, F.col("key").cast(kind)).alias(key), *_RUN[1:])


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    kept = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, kept)


class ProgressLog(StreamingQueryListener):
    """Rows read and rows that came behind the watermark, by query and batch."""

    def __init__(self) -> None:
        self.batches: dict[str, dict[int, tuple[int, int]]] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _end(self, query: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(query, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.batches.setdefault(str(p.id), {})[p.batchId] = (p.numInputRows, late)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.id)).set()

    def of(self, query: StreamingQuery, seconds: float = 60) -> dict[int, tuple[int, int]]:
        """``batch: (rows read, rows dropped)`` of a query that ended, all its events having arrived."""
        if not self._end(str(query.id)).wait(seconds):
            raise TimeoutError(f"the end of query {query.id} was not told")
        return self.batches.get(str(query.id), {})


def run_logged(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over what is there now into ``out`` by batch, and return ``batch, rows_read, rows_dropped``: the rows
    dropped are those that a stateful operator met behind the watermark."""
    log = ProgressLog()
    df.sparkSession.streams.addListener(log)
    try:
        q = df.writeStream.foreachBatch(by_batch(out)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        told = log.of(q)
    finally:
        df.sparkSession.streams.removeListener(log)
    return df.sparkSession.createDataFrame([(b, *x) for b, x in sorted(told.items())], "batch long, rows_read long, rows_dropped long")


def run_now(df: DataFrame, mode: str, columns: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Drive a stream over what is there now, each batch written as a table in the scratch folder, and return: in append
    mode all rows, in complete mode those of the last batch, in update mode the newest row for each of ``keys``."""
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of a row")
    spark = df.sparkSession
    out, check = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    made = spark.read.parquet(out)
    if mode == "update":
        return made.groupBy(*keys).agg(F.max_by(F.struct(*made.columns), "batch").alias("_r")).select("_r.*")
    return made if mode == "append" else made.where(F.col("batch") == made.agg(F.max("batch")).first()[0])
