"""Lookups, point-in-time joins, key resolution, set operations, top rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def perform_lookup(df: DataFrame, lookup: DataFrame, on: list[str], select: list[str] | None = None, how: str = "left", one_match: bool = True) -> DataFrame:
    """Join with a lookup table. With ``one_match`` the lookup counts once per key (its least row), so no row multiplies.
    Spark broadcasts the lookup if its statistics say that it is small."""
    side = lookup.select(*on, *[c for c in (select or [c for c in lookup.columns if c not in on])])
    if one_match:
        rest = [c for c in side.columns if c not in on]
        side = side.groupBy(*on).agg(F.min(F.struct(*rest)).alias("_r")).select(*on, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return df.join(side, on, how)


def join_many(base: DataFrame, others: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Left-join tables on the same keys; columns are prefixed by the table's name."""
    for name, other in others.items():
        base = base.join(other.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in other.columns if c not in keys]), keys, "left")
    return base


def asof_join(left: DataFrame, right: DataFrame, on: list[str], ts: str, right_ts: str, columns: list[str], tolerance: str | None = None, slice_size: int = 86_400) -> DataFrame:
    """For each left row the last right row of its keys that is not later, within ``tolerance`` (an interval text).

    Both sides are laid into one table, cut into slices of ``slice_size`` (seconds of a time, else units), and the last right
    row is carried forward within each; the last one of the slices before comes from a table with a row a slice. So nothing
    multiplies, and a hot key spreads over its slices. Right rows at the same time as a left row count; of several at one
    time the greatest. Left rows without a match keep nulls.
    """
    row = F.struct(F.col(right_ts).alias("t"), *columns)
    r = right.where(F.col(right_ts).isNotNull()).groupBy(*on, F.col(right_ts).alias("_t")).agg(F.max(row).alias("_r"))
    both = left.select(*on, F.col(ts).alias("_t"), F.struct(*left.columns).alias("_l")).unionByName(r, allowMissingColumns=True)
    kind = both.schema["_t"].dataType.typeName()
    place = F.unix_timestamp(F.col("_t").cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else F.col("_t").cast("double")
    both = both.withColumn("_s", F.floor(place / slice_size))
    w = Window.partitionBy(*on, "_s").orderBy(F.col("_t").asc_nulls_first(), F.col("_l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = Window.partitionBy(*[f"_on{i}" for i in range(len(on))]).orderBy(F.col("_p").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    slices = both.groupBy(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], F.col("_s").alias("_p")).agg(F.max("_r").alias("_last"))
    slices = slices.withColumn("_last", F.last("_last", ignorenulls=True).over(carried))
    same = F.col("_s").eqNullSafe(F.col("_p"))
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_on{i}"))
    held = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_l is not null")
    out = held.join(slices, same).withColumn("_m", F.coalesce("_m", "_last"))
    if tolerance:
        out = out.withColumn("_m", F.when(F.col("_m.t") >= F.col("_t") - F.expr(f"INTERVAL {tolerance}"), F.col("_m")))
    out = out.withColumn("_m", F.when(F.col("_t").isNotNull(), F.col("_m")))
    return out.select("_l.*", *[F.col(f"_m.{c}").alias(c) for c in columns])


def resolve_foreign_keys(fact: DataFrame, dim: DataFrame, business_key: str, dim_key: str, surrogate: str, target: str, at: str | None = None, valid_from: str = "valid_from", valid_to: str = "valid_to", unknown: int = -1) -> DataFrame:
    """Business key to surrogate key, of the version that is valid at ``at`` if given; unmatched: ``unknown``. Of several
    dimension rows that fit a fact the smallest surrogate counts, so no fact multiplies."""
    d = dim.select(F.col(dim_key).alias("_k"), F.col(surrogate).alias("_s"), *([F.col(valid_from).alias("_a"), F.col(valid_to).alias("_b")] if at else []))
    if not at:
        d = d.groupBy("_k").agg(F.min("_s").alias("_s"))
        return fact.join(d, fact[business_key] == d["_k"], "left").withColumn(target, F.coalesce("_s", F.lit(unknown))).drop("_k", "_s")
    # Which versions overlap is settled in the dimension: a version ends where one of a smaller surrogate holds.
    other = d.select(F.col("_k").alias("_k2"), F.col("_s").alias("_s2"), F.col("_a").alias("_a2"), F.col("_b").alias("_b2"))
    clash = d.join(other, (F.col("_k") == F.col("_k2")) & (F.col("_s2") < F.col("_s")) & (F.col("_a2") < F.col("_b")) & (F.col("_a") < F.col("_b2")))
    lesser = clash.groupBy("_k", "_s", "_a", "_b").agg(F.collect_set(F.struct("_a2", "_b2")).alias("_less"))
    d = d.distinct().join(lesser, ["_k", "_s", "_a", "_b"], "left")
    on = (fact[business_key] == d["_k"]) & (d["_a"] <= fact[at]) & (fact[at] < d["_b"])
    on = on & ~F.coalesce(F.exists("_less", lambda x: (x["_a2"] <= fact[at]) & (fact[at] < x["_b2"])), F.lit(False))
    return fact.join(d, on, "left").withColumn(target, F.coalesce("_s", F.lit(unknown))).drop("_k", "_s", "_a", "_b", "_less")


def orphans(fact: DataFrame, dim: DataFrame, business_key: str, dim_key: str) -> DataFrame:
    """Fact rows whose key the dimension does not have (null keys too)."""
    return fact.join(dim.select(F.col(dim_key).alias(business_key)).distinct(), business_key, "left_anti")


def ranking_features(candidates: DataFrame, users: DataFrame, items: DataFrame, interactions: DataFrame, user: str, item: str, user_affinity: str, item_affinity: str) -> DataFrame:
    """Candidates with the product of affinities and the item's popularity."""
    popular = interactions.groupBy(item).agg(F.count("*").alias("popularity"))
    out = candidates.join(users, user, "left").join(items, item, "left").join(popular, item, "left")
    return out.withColumns({"affinity": F.col(user_affinity) * F.col(item_affinity), "popularity": F.coalesce("popularity", F.lit(0)), "log_popularity": F.log1p(F.coalesce("popularity", F.lit(0)))})


def join_predictions_actuals(predictions: DataFrame, actuals: DataFrame, on: list[str]) -> DataFrame:
    return predictions.join(actuals, on, "inner")


def top_k(df: DataFrame, order_by: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order_by).limit(k)


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: list[str] | None = None) -> DataFrame:
    """The newest row per key; ties by ``tie``, then by the other columns."""
    rest = [c for c in df.columns if c not in keys]
    first = [ts, *(tie or [])]
    made = df.groupBy(*keys).agg(F.max(F.struct(*first, *[c for c in rest if c not in first])).alias("_r"))
    return made.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def top_k_per_group(df: DataFrame, keys: list[str], order_by: list[Column], k: int, rank: str | None = None) -> DataFrame:
    out = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))).where(F.col("_n") <= k)
    return out.withColumnRenamed("_n", rank) if rank else out.drop("_n")


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def except_rows(a: DataFrame, b: DataFrame, keep_all: bool = True) -> DataFrame:
    return a.exceptAll(b) if keep_all else a.subtract(b)


def intersect_rows(a: DataFrame, b: DataFrame, keep_all: bool = True) -> DataFrame:
    return a.intersectAll(b) if keep_all else a.intersect(b)
