"""Tables written between the steps of a job.

Iterative jobs cut their lineage here: a written table survives the loss of executors, which a local checkpoint does
not. The folder is the one that the cluster names in ``spark.checkpoint.dir``. A session without that setting gets a
temporary folder of the machine if it runs on this machine alone (a test, a notebook), else an error: executors would write
each to its own disk and the reader would miss their rows.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table that only this run reads."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if master.partition("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        base = f"file://{tempfile.gettempdir()}/quayside-scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_lock, _writing, _kept = threading.Lock(), [0], [""]


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is shuffled on the way to a table is not needed once the table stands. Of writes that overlap, the first sets
    the session's conf and the last one gives it back."""
    with _lock:
        _writing[0] += 1
        if _writing[0] == 1:
            _kept[0] = spark.conf.get(_CLEAN, "false")
            spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _lock:
            _writing[0] -= 1
            if not _writing[0]:
                spark.conf.set(_CLEAN, _kept[0])


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the scratch folder and read it back, with the same columns."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_go(spark):
        df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def file_order() -> Column:
    """The place of the file that a row of a written table was read from: by the task that wrote it, then the task's files.
    After a write dealt by ranges it grows with the ranges."""
    part = lambda pattern: F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast("long")
    return part(r"^part-(\d+)") * 1_000_000 + part(r"-c(\d+)")


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` gave back and that nothing reads any more. Other DataFrames are left alone."""
    for table in tables:
        path = table.__dict__.pop("_scratch", None)
        if path:
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
