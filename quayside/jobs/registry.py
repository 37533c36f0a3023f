"""How queries are registered: a name, a function of the tables, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def dirty(self) -> DataFrame:
        """Customers with padded names, odd spellings of missing values, e-mails and phones."""
        return self.customer.selectExpr(*[f"{e} AS {n}" for n, e in DIRTY.items()])


#: Columns of the dirty customers, in an SQL that both engines read alike.
DIRTY = {
    "id": "c_custkey",
    "name": "concat('  ', c_name, '   x ')",
    "status": "CASE WHEN c_custkey % 10 = 0 THEN 'N/A' WHEN c_custkey % 10 = 1 THEN ' ' WHEN c_custkey % 10 = 2 THEN NULL ELSE c_mktsegment END",
    "email": "CASE WHEN c_custkey % 7 = 0 THEN 'bad@INVALID' ELSE concat(' User', cast(c_custkey AS string), '@Mail.COM ') END",
    "phone": "CASE WHEN c_custkey % 9 = 0 THEN 'none' ELSE concat('(', cast(c_custkey % 900 + 100 AS string), ') 555-', cast(c_custkey % 10000 AS string)) END",
    "nation": "c_nationkey",
    "balance": "c_acctbal",
    "segment": "c_mktsegment",
}
DIRTY_SQL = "dirty AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in DIRTY.items()).replace("AS string", "AS VARCHAR") + " FROM customer)"


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables``."""

    def put(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return put
