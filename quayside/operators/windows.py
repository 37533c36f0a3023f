"""Window features. All columns of one frame come from one sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.names import column, unused

_AGG = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max}


def _w(partition_by: list[str], order_by: list):
    return Window.partitionBy(*partition_by).orderBy(*order_by)


def add_running_total(df: DataFrame, partition_by: list[str], order_by: list, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(column).over(_w(partition_by, order_by).rowsBetween(Window.unboundedPreceding, 0)))


def add_moving_average(df: DataFrame, partition_by: list[str], order_by: list, column: str, size: int, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(column).over(_w(partition_by, order_by).rowsBetween(-(size - 1), 0)))


def add_lag_lead_columns(df: DataFrame, partition_by: list[str], order_by: list, columns: list[str], periods: list[int]) -> DataFrame:
    w = _w(partition_by, order_by)
    return df.withColumns({f"{c}_{kind}_{p}": f(c, p).over(w) for c in columns for p in periods for kind, f in (("lag", F.lag), ("lead", F.lead))})


def add_percentile_rank(df: DataFrame, partition_by: list[str], order_by: list) -> DataFrame:
    w = _w(partition_by, order_by)
    return df.withColumns({"percent_rank": F.percent_rank().over(w), "cume_dist": F.cume_dist().over(w)})


def add_ntile(df: DataFrame, partition_by: list[str], order_by: list, n: int, name: str = "ntile") -> DataFrame:
    return df.withColumn(name, F.ntile(n).over(_w(partition_by, order_by)))


def rolling_window_features(df: DataFrame, partition_by: list[str], order_by: list, value: str, windows: list[int], aggs: list[str]) -> DataFrame:
    """Aggregates of the rows before the current one."""
    w = _w(partition_by, order_by)
    return df.withColumns({f"{value}_{a}_{n}": _AGG[a](value).over(w.rowsBetween(-n, -1)) for n in windows for a in aggs})


def velocity_features(df: DataFrame, key: str, ts: str, amount: str, hours: tuple[int, ...] = (1, 24, 168), slice_hours: int | None = None) -> DataFrame:
    """Number and sum of a key's rows in the hours up to and with the current one.

    A key's time is cut into slices (as long as the longest frame, if not said otherwise), each a window of its own, so a hot
    key spreads over as many tasks as it has slices. A row is counted in its own slice and, as an overlap, in those that its
    frame reaches into, but returned from its own only. Rows without a time count each other, as one window would have it.
    """
    longest = max(hours) * 3600
    width = (slice_hours or max(hours)) * 3600
    at, part, own = (unused(x, df.columns) for x in ("at", "part", "own"))
    first = F.floor(F.col(at) / width).cast("long")
    slices = F.coalesce(F.sequence(first, F.floor((F.col(at) + longest) / width).cast("long")), F.array(F.lit(None).cast("long")))
    dealt = df.withColumn(at, F.unix_timestamp(F.col(ts).cast("timestamp"))).withColumn(own, first).withColumn(part, F.explode(slices))
    w = Window.partitionBy(key, part).orderBy(at)
    counted = dealt.withColumns({f"{what}_{h}h": f.over(w.rangeBetween(-h * 3600, 0)) for h in hours for what, f in (("n", F.count("*")), ("sum", F.sum(amount)))})
    return counted.where(F.col(part).eqNullSafe(F.col(own))).drop(at, part, own)


def lag_features(df: DataFrame, series: list[str], ts: str, value: str, lags: list[int], rolling: list[int]) -> DataFrame:
    w = _w(series, [ts])
    out = {f"lag_{k}": F.lag(value, k).over(w) for k in lags}
    for n in rolling:
        out |= {f"rolling_mean_{n}": F.avg(value).over(w.rowsBetween(-n, -1)), f"rolling_std_{n}": F.stddev_samp(value).over(w.rowsBetween(-n, -1))}
    return df.withColumns(out)


def residual_anomalies(forecasts: DataFrame, actuals: DataFrame, on: list[str], series: list[str], predicted: str, actual: str, sigma: float = 3.0) -> DataFrame:
    """Residuals beyond ``sigma`` deviations from their series' mean."""
    r = forecasts.join(actuals, on).withColumn("residual", F.col(actual) - F.col(predicted))
    s = r.groupBy(*series).agg(F.avg("residual").alias("residual_mean"), F.stddev_samp("residual").alias("residual_std"))
    return r.join(s, series).withColumn("is_anomaly", F.coalesce(F.abs(F.col("residual") - F.col("residual_mean")) > sigma * F.col("residual_std"), F.lit(False)))


def time_since_event(df: DataFrame, key: str, ts: str, type_col: str, types: list[str], as_of: bool = True, unit_seconds: int = 3600, slice_hours: int = 24) -> DataFrame:
    """Time since the key's last event of each type: up to the row (``as_of``) or over all its rows.

    Up to the row, each slice of a key's time is a window of its own and gets the last events of the slices before it from
    a table with a row for each of them, so no task sees all rows of a hot key.
    """
    taken = [*df.columns, *[f"since_{x}" for x in types]]
    at, part, k, s = (unused(x, taken) for x in ("at", "part", "of_key", "of_part"))
    last = {x: unused(f"last_{i}", taken) for i, x in enumerate(types)}
    timed = df.withColumn(at, F.unix_timestamp(F.col(ts).cast("timestamp"))).withColumn(part, F.floor(F.col(at) / (slice_hours * 3600)))
    newest = {x: F.max(F.when(F.col(type_col) == x, F.col(at))) for x in types}
    if as_of:
        before = Window.partitionBy(k).orderBy(F.col(s).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        per = timed.groupBy(F.col(key).alias(k), F.col(part).alias(s)).agg(*[f.alias(last[x]) for x, f in newest.items()])
        per = per.select(k, s, *[F.max(n).over(before).alias(n) for n in last.values()])
        inside = Window.partitionBy(key, part).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
        seen = timed.withColumns({f"since_{x}": f.over(inside) for x, f in newest.items()})
        both = seen.join(per, F.col(key).eqNullSafe(F.col(k)) & F.col(part).eqNullSafe(F.col(s)))
        since = {x: F.coalesce(F.col(f"since_{x}"), F.col(last[x])) for x in types}
    else:
        per = timed.groupBy(F.col(key).alias(k)).agg(*[f.alias(last[x]) for x, f in newest.items()])
        both = timed.join(per, F.col(key).eqNullSafe(F.col(k)))
        since = {x: F.col(last[x]) for x in types}
    return both.select(*[column(c) for c in df.columns], *[((F.col(at) - c) / unit_seconds).alias(f"since_{x}") for x, c in since.items()])
