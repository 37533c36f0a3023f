"""Slowly changing dimensions, change data, incremental loads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators.enrichment import add_surrogate_key
from quayside.operators.joins import resolve_foreign_keys

OPEN_END = "9999-12-31"


def _same(columns: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _sides(a: DataFrame, b: DataFrame, keys: list[str], how: str = "full_outer") -> DataFrame:
    """``keys, _a, _b``: rows of both sides as structs, null where there is none. A null key is a key as any other."""
    left = a.select(*[F.col(k).alias(f"_l_{k}") for k in keys], F.struct(*a.columns).alias("_a"))
    right = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.struct(*b.columns).alias("_b"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_l_{k}").eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, same, how).select(*[F.coalesce(f"_l_{k}", f"_r_{k}").alias(k) for k in keys], "_a", "_b")


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], update_columns: list[str] | None = None) -> DataFrame:
    """Source rows replace or join the target's by key; with ``update_columns`` a match takes over only those. The source
    has one row per key: several make as many rows. A null key matches a null key, so a second run adds nothing."""
    out = []
    for c in target.columns:
        new = F.col(f"_b.{c}") if c in source.columns else F.lit(None).cast(target.schema[c].dataType)
        old = F.col(f"_a.{c}")
        takes = c in source.columns and (update_columns is None or c in update_columns or c in keys)
        out.append((F.when(F.col("_b").isNull(), old).when(F.col("_a").isNull(), new).otherwise(new if takes else old)).alias(c))
    return _sides(target, source, keys).select(*out)


def apply_scd_type1(source: DataFrame, target: DataFrame, keys: list[str], update_columns: list[str] | None = None) -> DataFrame:
    return merge_upsert(target, source, keys, update_columns)


def apply_scd_type2(df: DataFrame, keys: list[str], compare: list[str], effective: str) -> DataFrame:
    """A log of versions as history: ``effective_date, end_date, is_current, version``. Repeats without a change of
    ``compare`` collapse into the first."""
    w = Window.partitionBy(*keys).orderBy(effective, *[c for c in compare])
    now = F.struct(*compare)
    kept = df.withColumn("_p", F.lag(now).over(w)).withColumn("_n", F.row_number().over(w)).where(F.col("_n").eqNullSafe(F.lit(1)) | ~now.eqNullSafe(F.col("_p"))).drop("_p", "_n")
    nxt = F.lead(effective).over(w)
    kind = df.schema[effective].dataType
    return kept.select(*df.columns, F.col(effective).alias("effective_date"), F.coalesce(nxt, F.lit(OPEN_END).cast(kind)).alias("end_date"), nxt.isNull().alias("is_current"), F.row_number().over(w).alias("version"))


def apply_scd_type3(df: DataFrame, keys: list[str], order_by: list[str], columns: list[str], suffix: str = "_previous") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumns({f"{c}{suffix}": F.lag(c).over(w) for c in columns})


def close_scd_records(df: DataFrame, closing: DataFrame, keys: list[str], end: Column, end_col: str = "end_date", current: str = "is_current") -> DataFrame:
    """End the open rows of the given keys."""
    hit = F.coalesce("_hit", F.lit(False)) & F.col(current)
    marked = df.join(closing.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    return marked.withColumns({end_col: F.when(hit, end).otherwise(F.col(end_col)), current: F.col(current) & ~hit}).select(*df.columns)


def scd2_merge(target: DataFrame, source: DataFrame, keys: list[str], compare: list[str], at: str, *, valid_from: str = "valid_from", valid_to: str = "valid_to", current: str = "is_current", handle_deletes: bool = False) -> DataFrame:
    """Merge a snapshot into a history table: changed rows end at ``at`` and get a new version, unchanged and closed ones
    stay, new keys are inserted, keys missing from the source stay open or, with ``handle_deletes``, end.

    Only open rows are joined, once; each match gives one row or two by ``explode``. The source has one row per key.
    """
    opened = target.where(current)
    kind = target.schema[valid_from].dataType
    when = F.lit(at).cast(kind)
    new = F.struct(*[
        when.alias(c) if c == valid_from else F.lit(OPEN_END).cast(target.schema[c].dataType).alias(c) if c == valid_to else F.lit(True).alias(c) if c == current
        else F.col(f"_b.{c}").alias(c) if c in source.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    old = F.struct(*[F.col(f"_a.{c}").alias(c) for c in target.columns])
    ended = F.struct(*[when.cast(target.schema[c].dataType).alias(c) if c == valid_to else F.lit(False).alias(c) if c == current else F.col(f"_a.{c}").alias(c) for c in target.columns])
    rows = (
        F.when(F.col("_a").isNull(), F.array(new))
        .when(F.col("_b").isNull(), F.array(ended if handle_deletes else old))
        .when(_same(compare, "_a", "_b"), F.array(old))
        .otherwise(F.array(ended, new))
    )
    merged = _sides(opened, source, keys).select(F.explode(rows).alias("_r")).select("_r.*")
    return target.where(f"not {current} or {current} is null").unionByName(merged)


def compact_changes(changes: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The last change per key."""
    rest = [c for c in changes.columns if c not in keys]
    made = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_r"))
    return made.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in changes.columns])


def apply_cdc(target: DataFrame, changes: DataFrame, keys: list[str], seq: list[str], op: str = "op", apply_deletes: bool = True) -> DataFrame:
    """Apply changes: the last per key wins; c, u and r upsert, d removes (or is ignored)."""
    last = compact_changes(changes, keys, seq)
    gone = F.coalesce(F.col("_b")[op].isin("d", "delete", "D", "DELETE"), F.lit(False))
    out = [F.when(F.col("_b").isNull() | gone, F.col(f"_a.{c}")).otherwise(F.col(f"_b.{c}")).alias(c) for c in target.columns]
    both = _sides(target, last, keys)
    return (both.where(~gone) if apply_deletes else both.where(~gone | F.col("_a").isNotNull())).select(*out)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], seq: int = 0) -> DataFrame:
    """Changes that turn one snapshot into the other: the new row (the old one for a delete), ``op`` and ``seq``."""
    rest = [c for c in old.columns if c not in keys]
    op = F.when(F.col("_a").isNull(), "c").when(F.col("_b").isNull(), "d").when(~_same(rest, "_a", "_b"), "u")
    image = [F.when(F.col("_b").isNull(), F.col(f"_a.{c}")).otherwise(F.col(f"_b.{c}")).alias(c) for c in old.columns]
    return _sides(old, new, keys).withColumn("op", op).where("op is not null").select(*image, "op", F.lit(seq).alias("seq"))


def incremental_load(source: DataFrame, target: DataFrame, watermark: str) -> DataFrame:
    """Target and the source's rows that are newer than its newest; an empty target takes all."""
    top = target.agg(F.max(watermark).alias("_w"))
    fresh = source.join(F.broadcast(top), F.col("_w").isNull() | (F.col(watermark) > F.col("_w"))).drop("_w")
    return target.unionByName(fresh, allowMissingColumns=True)


def date_slices(start: str, end: str, days: int) -> list[tuple[str, str]]:
    """Half-open ranges of days."""
    import datetime

    a, z, out = datetime.date.fromisoformat(start), datetime.date.fromisoformat(end), []
    while a < z:
        b = min(a + datetime.timedelta(days=days), z)
        out.append((a.isoformat(), b.isoformat()))
        a = b
    return out


def backfill(job: Callable[[DataFrame, list[str]], DataFrame], df: DataFrame, ts: str, start: str, end: str, days: int = 1) -> DataFrame:
    """A job over the slices of a range of days, each named by its first day in ``slice``; write it with
    ``overwrite_partitions``. The rows are read once: ``job`` gets those of the whole range and the columns that tell the
    slices apart, by which it groups. Rows without a time are in no slice."""
    day = F.col(ts).cast("date")
    first = F.lit(start).cast("date")
    at = F.date_add(first, (F.floor(F.date_diff(day, first) / days) * days).cast("int"))
    return job(df.where((day >= first) & (day < F.lit(end).cast("date"))).withColumn("slice", at), ["slice"])


def fact_incremental(source: DataFrame, loaded: DataFrame, watermark: str, dimensions: list[tuple[DataFrame, str, str, str, str]], surrogate: str, order_by: list[str], start: int = 1) -> DataFrame:
    """The rows of ``source`` newer than the newest of ``loaded`` (all, if it is empty), with the keys of their dimensions,
    each given as (dimension, foreign key, its natural key, its surrogate key, new column) with -1 where there is none,
    and with surrogate keys of their own from ``start``."""
    top = loaded.agg(F.max(watermark).alias("_w"))
    fresh = source.join(F.broadcast(top), F.col("_w").isNull() | (F.col(watermark) > F.col("_w"))).drop("_w")
    for dimension, fk, nk, sk, name in dimensions:
        fresh = resolve_foreign_keys(fresh, dimension, fk, nk, sk, name)
    return add_surrogate_key(fresh, surrogate, order_by, start)


def catchup_slices(done: DataFrame, sources: DataFrame, source: str, day: str, start: str, now: str) -> DataFrame:
    """Days from ``start`` to before ``now`` that a source lacks."""
    due = sources.select(source).distinct().select(source, F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(now).cast("date"), 1))).alias(day))
    return due.join(done.select(source, F.col(day).cast("date").alias(day)).distinct(), [source, day], "left_anti")
