"""Groupings, pivots, subtotals, customer features, hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.scratch import materialize

_FUNCTIONS = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "stddev": F.stddev_samp, "variance": F.var_samp}


def aggregate_by_key(df: DataFrame, group_by: list[str], aggregations: dict[str, list[str]]) -> DataFrame:
    """``{column}_{function}`` per group; an unknown function is an error."""
    bad = {f for fs in aggregations.values() for f in fs} - set(_FUNCTIONS)
    if bad:
        raise ValueError(f"unknown functions {sorted(bad)}")
    return df.groupBy(*group_by).agg(*[_FUNCTIONS[f](c).alias(f"{c}_{f}") for c, fs in aggregations.items() for f in fs])


def aggregate_measures(df: DataFrame, group_by: list[str], measures: dict[str, str], where: str | None = None) -> DataFrame:
    """Measures written in SQL, over the rows for which ``where`` holds."""
    return (df.where(where) if where else df).groupBy(*group_by).agg(*[F.expr(e).alias(n) for n, e in measures.items()])


def pivot_table(df: DataFrame, index: list[str], column: str, values: list, measure: Column) -> DataFrame:
    """A column per listed value; listing them saves a pass over the data."""
    return df.groupBy(*index).pivot(column, values).agg(measure)


def rollup_aggregation(df: DataFrame, by: list[str], measures: list[Column]) -> DataFrame:
    return df.rollup(*by).agg(*measures, F.grouping_id().alias("grouping_id"))


def cube_aggregation(df: DataFrame, by: list[str], measures: list[Column]) -> DataFrame:
    return df.cube(*by).agg(*measures, F.grouping_id().alias("grouping_id"))


def grouping_sets(df: DataFrame, sets: list[list[str]], measures: list[Column]) -> DataFrame:
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*measures)


def gold_metrics(df: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Count, sum and mean per group, the largest sum first."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(amount).alias("revenue"), F.avg(amount).alias("avg_revenue")).orderBy(F.desc("revenue"), *by)


def rfm_features(orders: DataFrame, customer: str, ts: str, amount: str, as_of: str, windows: tuple[int, ...] = (7, 30, 90, 365)) -> DataFrame:
    """Recency, frequency and money per customer up to a day, in all and per window of days: one grouping."""
    day = F.lit(as_of).cast("date")
    age = F.datediff(day, F.col(ts).cast("date"))
    recent = [m for w in windows for m in (F.count(F.when(age < w, 1)).alias(f"orders_{w}d"), F.coalesce(F.sum(F.when(age < w, F.col(amount))), F.lit(0.0)).alias(f"spend_{w}d"))]
    return orders.where(F.col(ts).cast("date") <= day).groupBy(customer).agg(F.min(age).alias("recency_days"), F.count("*").alias("frequency"), F.sum(amount).alias("monetary"), F.avg(amount).alias("avg_order_value"), *recent)


def ancestors(edges: DataFrame, child: str, parent: str, most_levels: int = 50) -> DataFrame:
    """``(node, ancestor, depth)`` of a forest, each node its own ancestor at depth 0. Each round doubles nothing but
    climbs one level, and ends in a written table."""
    e = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("ancestor is not null").distinct()
    nodes = e.select("node").union(e.select(F.col("ancestor"))).distinct().select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    out, front = nodes, nodes
    for depth in range(1, most_levels + 1):
        up = e.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_up"))
        front = materialize(front.join(up, "ancestor").select("node", F.col("_up").alias("ancestor"), F.lit(depth).alias("depth")), "ancestors")
        if front.isEmpty():
            return out
        out = out.unionByName(front)
    raise ValueError(f"the hierarchy is deeper than {most_levels} levels or has a cycle")


def reconcile_bottom_up(leaves: DataFrame, edges: DataFrame, child: str, parent: str, key: str, value: str) -> DataFrame:
    """Sums of the leaves' values at every node above."""
    up = ancestors(edges, child, parent)
    return leaves.join(up, leaves[key] == up["node"]).groupBy("ancestor").agg(F.sum(value).alias(value)).withColumnRenamed("ancestor", key)


def reconcile_top_down(totals: DataFrame, history: DataFrame, group: str, key: str, total: str, past: str) -> DataFrame:
    """A group's total shared among its members as in the past."""
    share = history.groupBy(group, key).agg(F.sum(past).alias("_p")).withColumn("share", F.try_divide("_p", F.sum("_p").over(Window.partitionBy(group))))
    return share.join(totals, group).select(group, key, "share", (F.col(total) * F.col("share")).alias(total))
