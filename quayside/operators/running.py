"""Running sums over any number of rows: no task sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.names import column, unused
from quayside.functions.scratch import file_order, materialize


def running_sums(df: DataFrame, by: list[str], order_by: list[str], sums: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """``df`` with, for each new name of ``sums``, the sum of a column over the rows of the group up to this one, and for each
    of ``totals`` that over the whole group.

    Rows are dealt by ranges of group and order, sorted and written once. The sums of a group within a file (a row a file,
    or a row a group) give what comes before each file; within a file a window adds the rest. Null values add nothing, nulls
    of ``by`` are a group, rows equal in ``order_by`` follow each other as the sort leaves them.
    """
    totals = totals or {}
    keys = [column(c).asc_nulls_first() for c in [*by, *order_by]]
    held = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys), "running")
    taken = [*df.columns, *sums, *totals]
    file, at = unused("file", taken), unused("at", taken)
    values = {c: unused(f"of_{i}", taken) for i, c in enumerate(dict.fromkeys([*sums.values(), *totals.values()]))}
    own = held.select(file_order().alias(file), *map(column, by), *map(column, values)).groupBy(file, *by).agg(*[F.coalesce(F.sum(column(c)), F.lit(0)).alias(n) for c, n in values.items()])
    group = Window.partitionBy(*[column(c) for c in by] or [F.lit(0)])
    earlier = group.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    names = {c: unused(f"by_{i}", taken) for i, c in enumerate(by)}
    before = own.select(
        file, *[column(c).alias(n) for c, n in names.items()],
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in values.values()],
        *[F.sum(n).over(group).alias(f"{n}_all") for n in values.values()],
    )
    placed = held.select("*", file_order().alias(file), F.col("_metadata.row_index").alias(at))
    inside = Window.partitionBy(file, *map(column, by)).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.coalesce(F.sum(column(c)).over(inside), F.lit(0)).alias(n) for c, n in values.items()]).alias("l")
    same = F.col(f"l.{file}") == F.col(f"r.{file}")
    for c, n in names.items():
        same = same & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.{n}"))
    both = local.join(before.alias("r"), same)
    return both.select(
        *[F.col(f"l.`{c}`") for c in df.columns],
        *[(F.col(f"l.{values[c]}") + F.col(f"r.{values[c]}_before")).alias(n) for n, c in sums.items()],
        *[F.col(f"r.{values[c]}_all").alias(n) for n, c in totals.items()],
    )
