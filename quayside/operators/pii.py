"""Masking and removal of personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mask(c: Column, char: str, visible: int, position: str) -> Column:
    n = F.length(c)
    stars = F.repeat(F.lit(char), F.greatest(n - visible, F.lit(0)))
    shown = F.least(n, F.lit(visible))
    if position == "end":
        return F.concat(stars, F.substr(c, n - shown + 1))
    if position == "start":
        return F.concat(F.substr(c, F.lit(1), shown), stars)
    raise ValueError(f"position is start or end, not {position!r}")


def mask_column(df: DataFrame, columns: list[str], char: str = "*", visible: int = 4, position: str = "end") -> DataFrame:
    """All but ``visible`` characters at one end; the length stays."""
    return df.withColumns({c: _mask(F.col(c).cast("string"), char, visible, position) for c in columns})


def tokenize_column(df: DataFrame, columns: list[str], algorithm: str = "sha256", salt: str = "") -> DataFrame:
    hashed = {"sha256": lambda c: F.sha2(c, 256), "md5": F.md5}[algorithm]
    return df.withColumns({c: hashed(F.concat(F.col(c).cast("string"), F.lit(salt))) for c in columns})


def redact_email(df: DataFrame, columns: list[str]) -> DataFrame:
    """``****@domain``; text without a domain becomes ``****``."""
    domain = lambda c: F.regexp_extract(c, r"@(.+)$", 1)
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.when(domain(c) != "", F.concat(F.lit("****@"), domain(c))).otherwise("****")) for c in columns})


def anonymize_with_lookup(df: DataFrame, column: str, mapping: DataFrame, old: str, new: str, default: str | None = None) -> DataFrame:
    """Values by a mapping table; others become ``default``, or stay without one."""
    m = mapping.groupBy(F.col(old).alias(column)).agg(F.min(new).alias("_new"))
    rest = F.col(column) if default is None else F.lit(default)
    return df.join(m, column, "left").withColumn(column, F.coalesce("_new", rest)).select(*df.columns)


def remove_pii_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def redact_by_strategy(df: DataFrame, strategies: dict[str, str]) -> DataFrame:
    """hash, mask (the last four stay) or drop, per column."""
    make = {"hash": lambda c: F.sha2(c.cast("string"), 256), "mask": lambda c: _mask(c.cast("string"), "*", 4, "end")}
    bad = set(strategies.values()) - {*make, "drop"}
    if bad:
        raise ValueError(f"unknown strategies {sorted(bad)}")
    return df.withColumns({c: make[s](F.col(c)) for c, s in strategies.items() if s != "drop"}).drop(*[c for c, s in strategies.items() if s == "drop"])
