"""Validation flags, expectation reports, contracts, reconciliation, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.operators.cleaning import EMAIL


def _holds(condition: Column | str) -> Column:
    return F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))


def add_validation_flags(df: DataFrame, rules: dict[str, str], flag: str = "is_valid", per_rule: bool = False) -> DataFrame:
    """All rules hold (a null does not), and the names of those that fail."""
    made = {n: _holds(r) for n, r in rules.items()}
    every = F.lit(True)
    for c in made.values():
        every = every & c
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in made.items()]))
    return df.withColumns({flag: every, "failed_rules": failed} | ({f"{flag}_{n}": c for n, c in made.items()} if per_rule else {}))


def mark_invalid_rows(df: DataFrame, condition: str, flag: str = "is_invalid") -> DataFrame:
    return df.withColumn(flag, _holds(condition))


def split_valid_invalid(df: DataFrame, flag: str = "is_valid") -> dict[str, DataFrame]:
    """Both parts; a null flag is invalid."""
    ok = F.coalesce(F.col(flag), F.lit(False))
    return {"valid": df.where(ok), "invalid": df.where(~ok)}


def enforce_not_null(df: DataFrame, defaults: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in defaults.items()})


def _check(df: DataFrame, ok: Column, flag: str | None) -> DataFrame:
    return df.withColumn(flag, _holds(ok)) if flag else df.where(ok)


def validate_length(df: DataFrame, column: str, min_length: int = 0, max_length: int | None = None, flag: str | None = None) -> DataFrame:
    ok = F.length(column) >= min_length
    return _check(df, ok if max_length is None else ok & (F.length(column) <= max_length), flag)


def validate_pattern(df: DataFrame, column: str, pattern: str, flag: str | None = None) -> DataFrame:
    return _check(df, F.col(column).rlike(pattern), flag)


def validate_range(df: DataFrame, column: str, min_value=None, max_value=None, flag: str | None = None) -> DataFrame:
    """Bounds are inclusive."""
    ok = F.col(column).isNotNull()
    if min_value is not None:
        ok = ok & (F.col(column) >= min_value)
    if max_value is not None:
        ok = ok & (F.col(column) <= max_value)
    return _check(df, ok, flag)


def validate_email(df: DataFrame, column: str, flag: str | None = None) -> DataFrame:
    return validate_pattern(df, column, EMAIL, flag)


def check_not_null(df: DataFrame, columns: list[str], flag: str | None = None) -> DataFrame:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return _check(df, ok, flag)


def expectations_report(df: DataFrame, checks: dict[str, str], unique: list[list[str]] | None = None, references: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(check_name, n_rows, n_failed)``: all row checks in one aggregate, a grouping per uniqueness check, an anti-join
    per reference (column name to a frame with that column)."""
    wide = df.agg(F.count("*").alias("_n"), *[F.sum(F.when(_holds(c), 0).otherwise(1)).alias(n) for n, c in checks.items()])
    out = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col("_n").alias("n_rows"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n_failed")) for n in checks])).alias("r")).select("r.*")
    for keys in unique or []:
        groups = df.groupBy(*keys).agg(F.count("*").alias("c"))
        out = out.unionByName(groups.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("n_failed")).select(F.lit("unique_" + "_".join(keys)).alias("check_name"), "n_rows", "n_failed"))
    for column, other in (references or {}).items():
        marked = df.select(column).join(other.select(column).distinct().withColumn("_ok", F.lit(True)), column, "left")
        out = out.unionByName(marked.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.when(F.col(column).isNotNull() & F.col("_ok").isNull(), 1)), F.lit(0)).cast("long").alias("n_failed")).select(F.lit(f"reference_{column}").alias("check_name"), "n_rows", "n_failed"))
    return out


def enforce_contract(df: DataFrame, *, columns: dict[str, str] | None = None, min_rows: int = 0, ts: str | None = None, not_before: str | None = None, fail: bool = False) -> dict:
    """Schema, row count and freshness against what was agreed. One aggregate; ``fail`` raises on a breach."""
    have = dict(df.dtypes)
    breaches = [f"{c}: {have.get(c, 'missing')} instead of {k}" for c, k in (columns or {}).items() if have.get(c) != k]
    n, newest = df.agg(F.count("*"), F.max(ts) if ts else F.lit(None)).first()
    if n < min_rows:
        breaches.append(f"{n} rows, fewer than {min_rows}")
    if ts and not_before and (newest is None or str(newest) < not_before):
        breaches.append(f"newest {ts} is {newest}, before {not_before}")
    if breaches and fail:
        raise ValueError("; ".join(breaches))
    return {"rows": n, "newest": newest, "breaches": breaches}


def reconcile_tables(source: DataFrame, target: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    """``keys, status`` (missing, extra, different) of rows that differ. Order-free hashes per bucket of keys first, so
    that only rows of buckets that differ are joined. The buckets that differ, at most ``buckets`` numbers, are broadcast: a
    shuffle by bucket would put a bucket's rows into one task."""
    rest = [c for c in source.columns if c not in keys]
    slim = lambda df: df.select(*keys, F.xxhash64(*rest).alias("_h"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_b"))
    s, t = slim(source), slim(target)
    tally = lambda df, n: df.groupBy("_b").agg(F.sum(F.xxhash64(*keys, "_h").cast("decimal(38,0)")).alias(n))
    off = tally(s, "_x").join(tally(t, "_y"), "_b", "full_outer").where(~F.col("_x").eqNullSafe(F.col("_y"))).select("_b")
    off = F.broadcast(off)
    a, b = s.join(off, "_b", "left_semi").drop("_b"), t.join(off, "_b", "left_semi").drop("_b").withColumnRenamed("_h", "_g")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"_l{i}").eqNullSafe(F.col(f"_r{i}"))  # a null key meets a null key
    left = a.select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)], "_h", F.lit(1).alias("_s"))
    right = b.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], "_g", F.lit(1).alias("_t"))
    both = left.join(right, same, "full_outer")
    status = F.when(F.col("_t").isNull(), "missing").when(F.col("_s").isNull(), "extra").when(F.col("_h") != F.col("_g"), "different")
    names = [F.when(F.col("_s").isNull(), F.col(f"_r{i}")).otherwise(F.col(f"_l{i}")).alias(k) for i, k in enumerate(keys)]
    return both.select(*names, status.alias("status")).where("status is not null")


def freshness(df: DataFrame, ts: str, group: list[str], now: str, most_hours: float) -> DataFrame:
    lag = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp"))) / 3600
    return df.groupBy(*group).agg(F.max(ts).alias("newest")).withColumn("lag_hours", lag).withColumn("is_late", F.col("lag_hours") > most_hours)


def table_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """``(column, type, n_rows, n_null, n_distinct, min, max)`` of the plain columns: one aggregate, then unpivoted."""
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    count = F.countDistinct if exact else F.approx_count_distinct
    aggs = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count("*").alias("n_rows"), F.count(F.when(F.col(f.name).isNull(), 1)).alias("n_null"), count(F.col(f.name)).alias("n_distinct"), F.min(f.name).cast("string").alias("min"), F.max(f.name).cast("string").alias("max")) for f in fields]
    return df.agg(*[a.alias(f"c{i}") for i, a in enumerate(aggs)]).select(F.explode(F.array(*[f"c{i}" for i in range(len(fields))])).alias("r")).select("r.*")
