"""Exact quantiles of whole columns, found by rank: values are sorted by ranges over all tasks, none sees a whole column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators.enrichment import number_rows


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, v)``: a row per value of the columns that is not null."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns]))
    return df.select(each.alias("r")).select("r.column", "r.v").where("v is not null")


def quantiles(values: DataFrame, shares: list[float]) -> DataFrame:
    """``(column, share, q)``: the values between which each share of a column's rows lies, linearly interpolated.

    ``values``: ``(column, v)``; nulls are left out, equal values count each, and a column without values has no row. The
    ranks that are looked up are two a column and share.
    """
    ranked = number_rows(values.where("v is not null").select("column", "v"), ["column", "v"], "_n")
    sizes = ranked.groupBy("column").agg(F.count("*").alias("n"), F.min("_n").alias("first"))
    at = sizes.select("column", "first", (F.explode(F.array(*[F.lit(float(s)) for s in shares]))).alias("share"), "n").withColumn("at", (F.col("n") - 1) * F.col("share"))
    wanted = at.withColumns({"low": F.floor("at"), "high": F.ceil("at")})
    wanted = wanted.select("column", "share", "at", "low", "high", F.explode(F.array_distinct(F.array(F.col("first") + F.col("low"), F.col("first") + F.col("high")))).alias("_n"))
    ends = ranked.join(F.broadcast(wanted), ["column", "_n"]).groupBy("column", "share", "at", "low", "high").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return ends.select("column", "share", F.when(F.col("low") == F.col("high"), F.col("a")).otherwise((F.col("high") - F.col("at")) * F.col("a") + (F.col("at") - F.col("low")) * F.col("b")).alias("q"))


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with a column per name of ``wanted``, whose value says of which column of ``df`` it is which share."""
    shares = sorted({s for _, s in wanted.values()})
    found = quantiles(long_values(df, sorted({c for c, _ in wanted.values()})), shares)
    return found.agg(*[F.max(F.when((F.col("column") == c) & (F.col("share") == float(s)), F.col("q"))).alias(name) for name, (c, s) in wanted.items()])
