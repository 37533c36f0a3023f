"""Readers and writers."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.names import unused


def read_files(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options) -> DataFrame:
    """csv, json, parquet, orc, text or xml, with an explicit schema where there is one."""
    r = spark.read.format(kind).options(**options)
    return (r.schema(schema) if schema else r).load(path)


def read_partitioned(spark: SparkSession, path: str, partition: str, after: str | None = None, kind: str = "parquet") -> DataFrame:
    """Hive-style partitions, those after a watermark; the filter prunes folders."""
    df = spark.read.format(kind).load(path)
    return df if after is None else df.where(F.col(partition) > F.lit(after).cast(df.schema[partition].dataType))


def read_merged_schema(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def read_daily_drop(spark: SparkSession, path: str, kind: str, after: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """Files whose name carries a date (yyyyMMdd or yyyy-MM-dd), as ``file_date``; those after a watermark."""
    name = F.col("_metadata.file_name")
    digits = F.regexp_replace(F.regexp_extract(name, r"(\d{4}-?\d{2}-?\d{2})", 1), "-", "")
    df = read_files(spark, path, kind, schema, **options).withColumn("file_date", F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date"))
    return df if after is None else df.where(F.col("file_date") > F.lit(after).cast("date"))


def read_modified_since(spark: SparkSession, path: str, kind: str, since: str, schema: str | None = None) -> DataFrame:
    """Files modified after a time; the listing leaves the others out."""
    return read_files(spark, path, kind, schema, modifiedAfter=since)


def read_fixed_width(spark: SparkSession, path: str, spec: list[dict]) -> DataFrame:
    """Slices of lines: name, start (from 1), length, type, ``scale`` for digits with an implied point, ``signed`` for a sign
    that is punched over the last digit."""
    return slice_fixed_width(spark.read.text(path), "value", spec)


def slice_fixed_width(df: DataFrame, column: str, spec: list[dict]) -> DataFrame:
    out = []
    for f in spec:
        c = F.trim(F.substring(column, f["start"], f["length"]))
        kind = f.get("type", "string")
        if f.get("signed"):
            minus = c.rlike("[}J-R]$")
            c = F.concat(F.when(minus, "-").otherwise(""), F.translate(c, "{ABCDEFGHI}JKLMNOPQR", "01234567890123456789"))
        if f.get("scale"):
            c = F.try_divide(c.try_cast(f"decimal({f['length']},0)"), F.lit(10 ** f["scale"])).cast(kind)
        elif kind == "date":
            c = F.try_to_timestamp(c, F.lit(f.get("format", "yyyyMMdd"))).cast("date")
        elif kind != "string":
            c = c.try_cast(kind)
        out.append(c.alias(f["name"]))
    return df.select(*out)


_ITEM = re.compile(r"^(\d+)\s+([A-Z0-9-]+)?\s*(.*)$", re.IGNORECASE | re.DOTALL)
_SIGNS = re.compile(r"([X9A])(?:\((\d+)\))?", re.IGNORECASE)
_PICTURE = re.compile(r"(S?)((?:[X9A](?:\(\d+\))?)+)(?:V((?:9(?:\(\d+\))?)+))?", re.IGNORECASE)


def _signs(picture: str) -> int:
    return sum(int(n or 1) for _, n in _SIGNS.findall(picture))


def _field(name: str, picture: str, at: int) -> dict:
    m = _PICTURE.fullmatch(picture)
    if not m or (m.group(1) or m.group(3)) and re.search("[XA]", m.group(2), re.IGNORECASE):
        raise ValueError(f"{name}: picture {picture} is not read")
    scale = _signs(m.group(3) or "")
    length = _signs(m.group(2)) + scale
    field = {"name": name, "start": at, "length": length}
    if re.search("[XA]", m.group(2), re.IGNORECASE) is None:
        field |= {"type": f"decimal({length},{scale})"} | ({"scale": scale} if scale else {}) if scale or length > 18 else {"type": "bigint"}
        field |= {"signed": True} if m.group(1) else {}
    return field


def layout_from_copybook(text: str) -> list[dict]:
    """A fixed-width layout from a COBOL copybook: pictures of X, A and 9 with repeated or counted signs, an implied point
    and a sign punched over the last digit; ``OCCURS n`` repeats a field or a group, names then end in _1, _2 and so on.

    Names are lower-cased, hyphens become underscores, a repeated name (FILLER) gets a number from its second time on.
    Condition names (88) and comments are passed over. What would shift or change later fields is refused with a ValueError:
    binary and packed fields, REDEFINES, RENAMES, DEPENDING ON, signs of their own, edited pictures.
    """
    items = []
    for line in re.split(r"\.(?=\s|$)", "\n".join(x for x in text.splitlines() if not x.lstrip().startswith("*") and x[6:7] != "*")):
        m = _ITEM.match(line.strip())
        if not m or m.group(1) == "88":
            continue
        level, name, rest = int(m.group(1)), (m.group(2) or "filler").lower().replace("-", "_"), m.group(3).upper()
        if name in ("pic", "picture", "occurs"):
            name, rest = "filler", f"{name} {rest}".upper()
        if level == 66 or re.search(r"\b(REDEFINES|RENAMES|DEPENDING|SIGN|COMP(UTATIONAL)?(-\d)?|BINARY|PACKED-DECIMAL|INDEX|POINTER)\b", rest):
            raise ValueError(f"{name}: {' '.join(rest.split())} is not read")
        picture = re.search(r"\bPIC(?:TURE)?(?:\s+IS)?\s+(\S+)", rest)
        times = re.search(r"\bOCCURS\s+(\d+)", rest)
        items.append((level, name, picture and picture.group(1), int(times.group(1)) if times else None))
    out, seen, at = [], set(), 1

    def lay(first: int, end: int, suffix: str) -> None:
        nonlocal at
        while first < end:
            level, name, picture, times = items[first]
            after = next((i for i in range(first + 1, end) if items[i][0] <= level), end)
            for turn in range(1, (times or 1) + 1):
                own = f"{suffix}_{turn}" if times else suffix
                if picture:
                    base = full = f"{name}{own}"
                    again = 1
                    while full in seen:
                        again += 1
                        full = f"{base}_{again}"
                    seen.add(full)
                    out.append(_field(full, picture, at))
                    at += out[-1]["length"]
                else:
                    lay(first + 1, after, own)
            first = after

    lay(0, len(items), "")
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, driver: str | None = None, partition_column: str | None = None, lower: int | None = None, upper: int | None = None, num_partitions: int = 8, predicates: list[str] | None = None, fetchsize: int = 10_000) -> DataFrame:
    """A table or ``(query) t`` in parallel slices: by bounds of a number column, or one per predicate."""
    props = {"fetchsize": str(fetchsize)} | ({"driver": driver} if driver else {})
    if predicates:
        return spark.read.jdbc(url, table, predicates=predicates, properties=props)
    if partition_column:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper, numPartitions=num_partitions, properties=props)
    return spark.read.jdbc(url, table, properties=props)


def read_incremental(df: DataFrame, column: str, after, lookback: str | None = None) -> DataFrame:
    """Rows beyond a watermark, less a lookback interval for times. The filter reaches the scan."""
    if after is None:
        return df
    mark = F.lit(after).cast(df.schema[column].dataType)
    return df.where(F.col(column) > (mark - F.expr(f"INTERVAL {lookback}") if lookback else mark))


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "append", partition_by: list[str] | None = None) -> None:
    df.write.format(kind).mode(mode).partitionBy(*(partition_by or [])).save(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions that the batch has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def curve_place(df: DataFrame, by: list[str], bits: int = 6, sample: int = 10_000) -> Column:
    """A row's place on a Morton curve through the ranks of several columns: each value's range among 2^bits ranges of its
    column, the bits of all columns in turn. The ranges are cut from a sample of at most ``sample`` rows, which decides about
    their evenness alone. Nulls are in the first range."""
    rows = df.select(*by).orderBy(F.xxhash64(*by)).limit(sample).collect()
    place = F.lit(0).cast("long")
    for k, c in enumerate(by):
        values = sorted(r[c] for r in rows if r[c] is not None)
        cuts = sorted({values[len(values) * i // (1 << bits)] for i in range(1, 1 << bits)}) if values else []
        bounds = F.array(*[F.lit(v) for v in cuts]).cast(T.ArrayType(df.schema[c].dataType))
        rank = F.coalesce(F.size(F.filter(bounds, lambda x: x <= F.col(c))), F.lit(0))  # noqa: B023
        for i in range(bits):
            place = place + F.shiftleft(F.shiftright(rank, i).bitwiseAND(1).cast("long"), i * len(by) + k)
    return place


def write_clustered(df: DataFrame, path: str, by: list[str], files: int, rows_per_file: int = 5_000_000) -> None:
    """Files by ranges of a column, or of a curve through several, so that filters on any of them skip files."""
    name = unused("place", df.columns)
    dealt = df.withColumn(name, F.col(by[0]) if len(by) == 1 else curve_place(df, by))
    dealt = dealt.repartitionByRange(files, name).sortWithinPartitions(name, *by).drop(name)
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def align_schema(df: DataFrame, target: T.StructType, policy: str = "merge_schemas") -> DataFrame:
    """The target's columns in its order, missing ones null; further columns last, unless ``strict`` (an error)."""
    have = set(df.columns)
    extra = [c for c in df.columns if c not in target.fieldNames()]
    missing = [f.name for f in target.fields if f.name not in have]
    if policy == "strict" and (extra or missing):
        raise ValueError(f"columns differ: missing {missing}, further {extra}")
    if policy not in ("strict", "add_new_columns", "merge_schemas"):
        raise ValueError(f"unknown policy {policy!r}")
    cols = [(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in target.fields]
    return df.select(*cols, *extra)


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(change, column, from_type, to_type)``: added, removed and retyped columns."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    rows = [("added", c, None, b[c]) for c in b if c not in a] + [("removed", c, a[c], None) for c in a if c not in b] + [("retyped", c, a[c], b[c]) for c in a if c in b and a[c] != b[c]]
    return old.sparkSession.createDataFrame(rows, "change string, column string, from_type string, to_type string")


WATERMARKS = "ingestor string, source string, env string, watermark_value string, watermark_type string, last_updated timestamp, metadata map<string,string>"


def latest_watermark(marks: DataFrame) -> DataFrame:
    """The newest watermark per ingestor, source, environment and type."""
    keys = ["ingestor", "source", "env", "watermark_type"]
    return marks.groupBy(*keys).agg(F.max_by("watermark_value", F.struct("last_updated", "watermark_value")).alias("watermark_value"), F.max("last_updated").alias("last_updated"))


def next_watermark(batch: DataFrame, column: str, ingestor: str, source: str, env: str, kind: str) -> DataFrame:
    """The row to append after a batch; an empty batch gives none."""
    top = batch.agg(F.max(column).cast("string").alias("watermark_value")).where("watermark_value is not null")
    return top.select(F.lit(ingestor).alias("ingestor"), F.lit(source).alias("source"), F.lit(env).alias("env"), "watermark_value", F.lit(kind).alias("watermark_type"), F.current_timestamp().alias("last_updated"), F.create_map().cast("map<string,string>").alias("metadata"))


def run_audited(
    df: DataFrame, path: str, job: str, mode: str = "append", *, watermark: str | None = None, after=None, transform: Callable[[DataFrame], DataFrame] | None = None
) -> dict:
    """Write a batch to a Parquet table and give an audit row: ``job, rows_read, rows_written, watermark_before,
    watermark_after, schema_changes, seconds, status, error``.

    With ``watermark`` only rows beyond ``after`` are read, and the new watermark is the largest value read, the old one if
    there is none. Rows are counted, and the watermark found, while they pass (``observe``): neither the source nor the table
    is read again. A stage of a shuffle that runs twice may count rows read twice; rows written are those of tasks that
    succeeded. ``schema_changes``: columns that the table, as it was, has not, lacks, or has with another type. A run that
    fails gives a row with the error, no rows written and the old watermark.
    """
    spark, began = df.sparkSession, time.time()
    out = {"job": job, "rows_read": 0, "rows_written": 0, "watermark_before": None if after is None else str(after), "watermark_after": None if after is None else str(after), "schema_changes": []}
    read, written = Observation(f"read-{uuid.uuid4().hex}"), Observation(f"written-{uuid.uuid4().hex}")
    try:
        rows = read_incremental(df, watermark, after) if watermark else df
        top = [F.max(F.col(watermark).cast(df.schema[watermark].dataType)).cast("string").alias("top")] if watermark else []
        rows = rows.observe(read, F.count(F.lit(1)).alias("n"), *top)
        rows = (transform(rows) if transform else rows).observe(written, F.count(F.lit(1)).alias("n"))
        out["schema_changes"] = _changes(spark, path, rows.schema) if mode == "append" else []
        rows.write.mode(mode).parquet(path)
        out |= {"rows_read": read.get.get("n", 0), "rows_written": written.get.get("n", 0)}
        out["watermark_after"] = read.get.get("top") or out["watermark_before"]
        error = None
    except Exception as e:
        error = str(e)[:500]
    return out | {"seconds": time.time() - began, "status": "failed" if error else "succeeded", "error": error}


def _changes(spark: SparkSession, path: str, schema: T.StructType) -> list[str]:
    try:
        held = spark.read.option("mergeSchema", True).parquet(path).schema
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return []
        if "CANNOT_MERGE_SCHEMAS" not in str(e):
            raise
        held = spark.read.parquet(path).schema  # files of different types: one of them stands for the table
    old, new = ({f.name: f.dataType.simpleString() for f in x.fields} for x in (held, schema))
    added = [f"added {c} {new[c]}" for c in new if c not in old]
    gone = [f"removed {c} {old[c]}" for c in old if c not in new]
    return added + gone + [f"retyped {c} {old[c]} {new[c]}" for c in new if c in old and old[c] != new[c]]
