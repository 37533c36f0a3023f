"""Cleaning of columns and rows. Every function returns one projection or filter over its input."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.operators.quantiles import quantile_row

#: Spellings of a missing value.
NULL_WORDS = ["", "NULL", "null", "Null", "N/A", "n/a", "NA", "None", "none", "#N/A"]
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


def _each(df: DataFrame, columns: Iterable[str], make: Callable[[Column], Column]) -> DataFrame:
    """Replace columns in one projection."""
    return df.withColumns({c: make(F.col(c)) for c in columns})


def _strings(df: DataFrame, columns: list[str] | None) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows."""
    return df.dropDuplicates()


def drop_duplicates_by_key(df: DataFrame, key_columns: list[str], order_by: list[str], keep: str = "first") -> DataFrame:
    """One whole row per key: the first or last by ``order_by``, ties by the other columns. Nulls come first."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep is first or last, not {keep!r}")
    rest = [c for c in df.columns if c not in key_columns]
    order = F.struct(*order_by, *[c for c in rest if c not in order_by])
    pick = (F.min if keep == "first" else F.max)(order).alias("_row")
    return df.groupBy(*key_columns).agg(pick).select(*[F.col(c) if c in key_columns else F.col(f"_row.{c}").alias(c) for c in df.columns])


def standardize_nulls(df: DataFrame, null_values: list[str] | None = None, columns: list[str] | None = None, trim: bool = True) -> DataFrame:
    """Spellings of a missing value become NULL, in string columns."""
    words = NULL_WORDS if null_values is None else null_values
    return _each(df, _strings(df, columns), lambda c: F.when(~(F.trim(c) if trim else c).isin(words), c))


def trim_and_clean_strings(df: DataFrame, columns: list[str] | None = None, case: str | None = None, remove_special: bool = False) -> DataFrame:
    """White space collapsed and trimmed; on request specials removed and the case made one."""

    def clean(c: Column) -> Column:
        if remove_special:
            c = F.regexp_replace(c, r"[^a-zA-Z0-9\s]", "")
        c = F.trim(F.regexp_replace(c, r"\s+", " "))
        return {None: lambda x: x, "lower": F.lower, "upper": F.upper}[case](c)

    return _each(df, _strings(df, columns), clean)


def normalize_case(df: DataFrame, columns: list[str], case: str = "lower") -> DataFrame:
    return _each(df, columns, {"lower": F.lower, "upper": F.upper, "title": F.initcap}[case])


def remove_special_characters(df: DataFrame, columns: list[str], replacement: str = "") -> DataFrame:
    return _each(df, columns, lambda c: F.regexp_replace(c, r"[^a-zA-Z0-9\s]", replacement))


def replace_values(df: DataFrame, mappings: dict[str, dict]) -> DataFrame:
    """Values by a map per column; others stay."""
    out = {}
    for name, pairs in mappings.items():
        c = F.col(name)
        made = None
        for old, new in pairs.items():
            made = F.when(c == F.lit(old), F.lit(new)) if made is None else made.when(c == F.lit(old), F.lit(new))
        out[name] = c if made is None else made.otherwise(c)
    return df.withColumns(out)


def fill_nulls(df: DataFrame, defaults: dict) -> DataFrame:
    return df.fillna(defaults)


def drop_null_rows(df: DataFrame, columns: list[str] | None = None, how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=columns)


def coalesce_columns(df: DataFrame, target: str, sources: list[str], drop_sources: bool = False) -> DataFrame:
    out = df.withColumn(target, F.coalesce(*sources))
    return out.drop(*[s for s in sources if s != target]) if drop_sources else out


def filter_by_condition(df: DataFrame, condition: str) -> DataFrame:
    return df.where(F.expr(condition))


def remove_outliers_iqr(df: DataFrame, column: str, multiplier: float = 1.5, exact: bool = True) -> DataFrame:
    """Rows within the quartiles widened by ``multiplier`` ranges. The bounds are one row, joined by broadcast; with
    ``exact=False`` the quartiles come from a sketch of bounded size."""
    if exact:
        quartiles = quantile_row(df, {"_a": (column, 0.25), "_b": (column, 0.75)})
    else:
        quartiles = df.agg(F.percentile_approx(column, 0.25, 10000).alias("_a"), F.percentile_approx(column, 0.75, 10000).alias("_b"))
    b = quartiles.select((F.col("_a") - multiplier * (F.col("_b") - F.col("_a"))).alias("_lo"), (F.col("_b") + multiplier * (F.col("_b") - F.col("_a"))).alias("_hi"))
    return df.join(F.broadcast(b), F.col(column).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def deduplicate_array_column(df: DataFrame, column: str) -> DataFrame:
    return _each(df, [column], F.array_distinct)


def remove_empty_arrays(df: DataFrame, column: str) -> DataFrame:
    """Empty arrays become NULL."""
    return _each(df, [column], lambda c: F.when(F.size(c) > 0, c))


def clean_email_addresses(df: DataFrame, columns: list[str]) -> DataFrame:
    """Trimmed and lower-cased if it has the form of an address, else NULL."""
    return _each(df, columns, lambda c: F.when(F.trim(c).rlike(EMAIL), F.lower(F.trim(c))))


def clean_phone_numbers(df: DataFrame, columns: list[str], country_code: str = "") -> DataFrame:
    """Digits only, after the country code; without digits NULL."""
    digits = lambda c: F.regexp_replace(c, r"[^0-9]", "")
    return _each(df, columns, lambda c: F.when(digits(c) != "", F.concat(F.lit(country_code), digits(c))))


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def cast_column(df: DataFrame, column: str, kind: str, strict: bool = False) -> DataFrame:
    """``strict``: a value that cannot be cast is an error, else NULL."""
    return _each(df, [column], lambda c: c.cast(kind) if strict else c.try_cast(kind))


def round_numbers(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    return _each(df, columns, lambda c: F.round(c, digits))


def normalize_numeric(df: DataFrame, column: str, method: str = "min_max", target: str | None = None) -> DataFrame:
    """Min-max to [0, 1] or z-score; a constant column gives 0."""
    if method == "min_max":
        s = df.agg(F.min(column).alias("_m"), (F.max(column) - F.min(column)).alias("_s"))
    elif method == "z_score":
        s = df.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    else:
        raise ValueError(f"unknown method {method!r}")
    scaled = F.when(F.col(column).isNotNull(), F.coalesce(F.try_divide(F.col(column) - F.col("_m"), F.col("_s")), F.lit(0.0)))
    return df.crossJoin(F.broadcast(s)).withColumn(target or column, scaled).drop("_m", "_s")


def regex_extract(df: DataFrame, column: str, pattern: str, target: str, group: int = 1) -> DataFrame:
    return df.withColumn(target, F.regexp_extract(column, pattern, group))


def replace_string(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return _each(df, [column], lambda c: F.replace(c, F.lit(old), F.lit(new)))


def parse_date(df: DataFrame, column: str, pattern: str, target: str | None = None) -> DataFrame:
    """Text to a date; what does not fit becomes NULL."""
    return df.withColumn(target or column, F.try_to_timestamp(column, F.lit(pattern)).cast("date"))


def extract_date_part(df: DataFrame, column: str, part: str, target: str) -> DataFrame:
    return df.withColumn(target, F.date_part(F.lit(part), column).cast("int"))


#: Steps that a configuration can name.
STEPS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (
    drop_exact_duplicates, drop_duplicates_by_key, standardize_nulls, trim_and_clean_strings, normalize_case, remove_special_characters,
    replace_values, fill_nulls, drop_null_rows, coalesce_columns, filter_by_condition, remove_outliers_iqr, deduplicate_array_column,
    remove_empty_arrays, clean_email_addresses, clean_phone_numbers, select_columns, rename_columns, cast_column, round_numbers,
    normalize_numeric, regex_extract, replace_string, parse_date, extract_date_part,
)}


def apply_chain(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Steps in turn: ``{"name": ..., "params": {...}, "when": bool}``. An unknown name is an error."""
    for step in steps:
        if step["name"] not in STEPS:
            raise ValueError(f"unknown step {step['name']!r}")
        if step.get("when", True):
            df = df.transform(STEPS[step["name"]], **step.get("params", {}))
    return df


def apply_if(df: DataFrame, condition: bool, step: Callable[..., DataFrame], **params) -> DataFrame:
    return df.transform(step, **params) if condition else df
