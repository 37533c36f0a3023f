"""Added columns: audit data, keys, dates, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.names import column, unused
from quayside.functions.scratch import file_order, materialize


def add_audit_columns(df: DataFrame, user: str) -> DataFrame:
    now = F.current_timestamp()
    return df.withColumns({"created_at": now, "created_by": F.lit(user), "updated_at": now, "updated_by": F.lit(user)})


def add_ingestion_metadata(df: DataFrame, source: str, batch_id: str, source_file: bool = False) -> DataFrame:
    out = df.withColumn("_source_file", F.col("_metadata.file_path")) if source_file else df
    return out.withColumns({"_ingested_at": F.current_timestamp(), "_ingestion_date": F.current_date(), "_source": F.lit(source), "_batch_id": F.lit(batch_id)})


def number_rows(df: DataFrame, order_by: list[str], name: str, start: int = 0) -> DataFrame:
    """Dense numbers from ``start`` in the order of columns, without a task that sees all rows: ranges of the order are
    sorted and written once, and a row's number is its place in its file plus the rows of the files before (a list as
    long as the number of files). Rows equal in ``order_by`` are numbered as the sort leaves them."""
    keys = [column(c).asc_nulls_first() for c in order_by]
    held = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys), "numbered")
    file, at, before = (unused(x, [*df.columns, name]) for x in ("file", "at", "before"))
    sizes = held.groupBy(file_order().alias(file)).agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select(file, F.coalesce(earlier, F.lit(0)).alias(before))
    placed = held.select("*", file_order().alias(file), F.col("_metadata.row_index").alias(at))
    kept = [column(c) for c in df.columns if c.lower() != name.lower()]
    return placed.join(F.broadcast(firsts), file).select(*kept, (F.col(before) + F.col(at) + start).alias(name))


def number_within(df: DataFrame, group: str, order_by: list[str], name: str, size: str | None = None) -> DataFrame:
    """Numbers from 0 within each value of ``group`` (null is one), in the order of columns, and the rows of the group as
    ``size``. No task sees a whole group: all rows are numbered by group and order, less the group's first number."""
    numbered = number_rows(df, [group, *order_by], name)
    own, first, count = (unused(x, [*numbered.columns, size or ""]) for x in ("own", "first", "count"))
    of_group = numbered.groupBy(column(group).alias(own)).agg(F.min(column(name)).alias(first), F.count("*").alias(count))
    both = numbered.join(of_group, column(group).eqNullSafe(F.col(own)))
    kept = [column(c) for c in df.columns if c.lower() not in (name.lower(), (size or "").lower())]
    return both.select(*kept, (column(name) - F.col(first)).alias(name), *([F.col(count).alias(size)] if size else []))


def add_surrogate_key(df: DataFrame, name: str, order_by: list[str] | None = None, start: int = 0) -> DataFrame:
    """Unique growing numbers; dense and in order if ``order_by`` is given."""
    if order_by:
        return number_rows(df, order_by, name, start)
    return df.withColumn(name, F.monotonically_increasing_id() + start)


def add_hash_key(df: DataFrame, columns: list[str], target: str, algorithm: str = "sha256", null_token: str | None = None) -> DataFrame:
    """Hash of the columns joined by ``||``. Nulls are skipped unless a token stands for them."""
    text = [F.col(c).cast("string") for c in columns]
    if null_token is not None:
        text = [F.coalesce(c, F.lit(null_token)) for c in text]
    joined = F.concat_ws("||", *text)
    hashed = {"md5": F.md5, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512)}
    return df.withColumn(target, hashed[algorithm](joined))


def add_date_components(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}_year": F.year(column), f"{prefix}_month": F.month(column), f"{prefix}_day": F.dayofmonth(column)})


def add_age_from_birthdate(df: DataFrame, column: str, ref_date: str, target: str = "age") -> DataFrame:
    return df.withColumn(target, (F.datediff(F.lit(ref_date).cast("date"), F.col(column)) / 365.25).cast("int"))


def add_tenure_months(df: DataFrame, start: str, end: Column, target: str = "tenure_months") -> DataFrame:
    """Whole months."""
    return df.withColumn(target, F.floor(F.months_between(end, F.col(start))).cast("int"))


def add_business_key(df: DataFrame, columns: list[str], target: str, sep: str = "-") -> DataFrame:
    return df.withColumn(target, F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]))


def sql_transform(df: DataFrame, sql: str, **others: DataFrame) -> DataFrame:
    """SQL over ``{input_table}`` and other frames by name."""
    return df.sparkSession.sql(sql, input_table=df, **others)


def render_template(df: DataFrame, template: str, variables: list[str], target: str) -> DataFrame:
    """Text with ``{name}`` replaced by the columns' values; a null is an empty text. Values are not looked at for
    further variables."""
    parts, rest = [], template
    while rest:
        found = [(rest.find("{" + v + "}"), v) for v in variables if "{" + v + "}" in rest]
        if not found:
            parts.append(F.lit(rest))
            break
        at, v = min(found)
        parts += [F.lit(rest[:at]), F.coalesce(F.col(v).cast("string"), F.lit(""))]
        rest = rest[at + len(v) + 2 :]
    return df.withColumn(target, F.concat(*parts))


def add_row_number(df: DataFrame, partition_by: list[str], order_by: list, name: str = "row_number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order_by)))


def add_rank(df: DataFrame, partition_by: list[str], order_by: list, dense: bool = False, name: str = "rank") -> DataFrame:
    return df.withColumn(name, (F.dense_rank() if dense else F.rank()).over(Window.partitionBy(*partition_by).orderBy(*order_by)))
