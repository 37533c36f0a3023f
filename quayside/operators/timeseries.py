"""Forecasts per series, their accuracy, intervals and corrections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators.features import assemble
from quayside.operators.windows import lag_features


def _design(t: np.ndarray, period: int, harmonics: int) -> np.ndarray:
    cols = [np.ones_like(t), t]
    for k in range(1, harmonics + 1):
        cols += [np.sin(2 * np.pi * k * t / period), np.cos(2 * np.pi * k * t / period)]
    return np.stack(cols, axis=1)


def forecast_series(df: DataFrame, series: str, date: str, y: str, periods: int, period: int = 7, harmonics: int = 2, z: float = 1.96, regressors: list[str] | None = None, future: DataFrame | None = None) -> DataFrame:
    """``series, date, y, yhat, lower, upper, is_anomaly, is_future`` per day: least squares on trend, seasons and the means
    of the day's ``regressors``, one series a group, with an interval from the residuals. A series of fewer days than the
    model has terms gets its mean. ``future`` has the regressors of days to come (series, date, regressors); a value that a
    day lacks is that of the day before, at the beginning the first one there is, and 0 in a series without any. Series that only
    ``future`` has get no forecast."""
    extra = [f"x{i}" for i in range(len(regressors or []))]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        known, pdf = pdf.set_index(pd.to_datetime(pdf["d"]))[extra].astype(float), pdf[pdf["y"].notna()]
        day = pd.to_datetime(pdf["d"])
        t = (day - day.iloc[0]).dt.days.to_numpy(float)
        v = pdf["y"].to_numpy(float)
        ahead = t[-1] + np.arange(1, periods + 1)
        every = np.concatenate((t, ahead))
        dates = [day.iloc[0] + pd.Timedelta(days=int(k)) for k in every]
        known = known.reindex(known.index.union(dates)).ffill().bfill().fillna(0.0).loc[dates].to_numpy()
        design = np.hstack((_design(every, period, harmonics), known))
        x = design[: len(t)]
        if len(t) > x.shape[1]:
            beta = np.linalg.lstsq(x, v, rcond=None)[0]
            hat = design @ beta
            s = float(np.sqrt(((v - hat[: len(t)]) ** 2).sum() / (len(t) - x.shape[1])))
        else:
            hat, s = np.full(len(every), v.mean()), float(v.std())
        actual = np.concatenate((v, np.full(periods, np.nan)))
        odd = np.abs(actual - hat) > z * s
        return pd.DataFrame({series: pdf["s"].iloc[0], date: [d.date() for d in dates], y: pd.Series(actual), "yhat": hat, "lower": hat - z * s, "upper": hat + z * s, "is_anomaly": odd & (np.arange(len(every)) < len(t)), "is_future": np.arange(len(every)) >= len(t)})

    kind = df.schema[series].dataType.simpleString()
    daily = df.where(F.col(y).isNotNull() & F.col(date).isNotNull()).groupBy(F.col(series).alias("s"), F.col(date).cast("date").alias("d")).agg(F.sum(F.col(y).cast("double")).alias("y"), *[F.avg(F.col(c).cast("double")).alias(x) for c, x in zip(regressors or [], extra)])
    if future is not None:
        values = [F.avg(F.col(c).cast("double")).alias(x) for c, x in zip(regressors or [], extra)]
        ahead = future.where(F.col(date).isNotNull()).groupBy(F.col(series).alias("s"), F.col(date).cast("date").alias("d")).agg(F.lit(None).cast("double").alias("y"), *values)
        daily = daily.unionByName(ahead.join(daily.select("s").distinct(), "s", "left_semi").join(daily.select("s", "d"), ["s", "d"], "left_anti"))
    return daily.groupBy("s").applyInPandas(fit, f"{series} {kind}, {date} date, {y} double, yhat double, lower double, upper double, is_anomaly boolean, is_future boolean")


def global_forecaster(train: DataFrame, test: DataFrame, series: list[str], ts: str, y: str, lags: tuple[int, ...] = (1, 7), trees: int = 20) -> DataFrame:
    """One boosted model over the lags of all series; ``test`` with ``prediction``. Lags reach back into ``train``."""
    both = lag_features(train.withColumn("_test", F.lit(False)).unionByName(test.withColumn("_test", F.lit(True))), series, ts, y, list(lags), [7]).dropna(subset=[f"lag_{k}" for k in lags]).fillna(0.0)
    made = assemble(both, [f"lag_{k}" for k in lags] + ["rolling_mean_7"], "_f")
    m = GBTRegressor(featuresCol="_f", labelCol=y, maxIter=trees, seed=1).fit(made.where("not _test"))
    return m.transform(made.where("_test")).drop("_f", "_test")


def quantile_intervals(forecasts: DataFrame, residuals: DataFrame, series: list[str], point: str, residual: str, qs: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Point forecasts plus the empirical quantiles of their series' residuals."""
    q = residuals.groupBy(*series).agg(*[F.percentile(residual, F.lit(p)).alias(f"_q{int(p * 100)}") for p in qs])
    return forecasts.join(q, series, "left").withColumns({f"q{int(p * 100)}": F.col(point) + F.coalesce(F.col(f"_q{int(p * 100)}"), F.lit(0.0)) for p in qs}).drop(*[f"_q{int(p * 100)}" for p in qs])


def forecast_accuracy(forecasts: DataFrame, actuals: DataFrame, on: list[str], series: list[str], predicted: str, actual: str) -> DataFrame:
    """Mean absolute, root mean square and mean absolute percentage error (actuals of 0 left out), bias."""
    e = F.col(actual) - F.col(predicted)
    return forecasts.join(actuals, on).groupBy(*series).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(F.try_divide(e, F.col(actual))) * 100).alias("mape"), F.avg(-e).alias("bias"), F.count("*").alias("n"))


def correct_bias(forecasts: DataFrame, recent: DataFrame, predicted: str, actual: str, method: str = "additive") -> DataFrame:
    """Forecasts less their recent mean error, or times the ratio of recent means."""
    b = recent.agg(F.avg(F.col(predicted) - F.col(actual)).alias("_e"), F.try_divide(F.avg(actual), F.avg(predicted)).alias("_r"))
    made = F.col(predicted) - F.coalesce("_e", F.lit(0.0)) if method == "additive" else F.col(predicted) * F.coalesce("_r", F.lit(1.0))
    return forecasts.crossJoin(F.broadcast(b)).withColumn("corrected", made).drop("_e", "_r")


def compare_versions(a: DataFrame, b: DataFrame, actuals: DataFrame, on: list[str], predicted: str, actual: str, threshold: float = 0.0) -> DataFrame:
    """Percentage errors of two versions, the improvement of the second, and whether to go back to the first."""
    both = a.withColumn("_v", F.lit("a")).unionByName(b.withColumn("_v", F.lit("b"))).join(actuals, on)
    err = F.abs(F.try_divide(F.col(actual) - F.col(predicted), F.col(actual))) * 100
    return both.agg(F.avg(F.when(F.col("_v") == "a", err)).alias("mape_a"), F.avg(F.when(F.col("_v") == "b", err)).alias("mape_b")).select("mape_a", "mape_b", (F.col("mape_a") - F.col("mape_b")).alias("improvement"), (F.col("mape_b") - F.col("mape_a") > threshold).alias("rollback"))
