"""JSON, arrays, structs, delimited text and change envelopes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _kind(text: str, at: int) -> tuple[T.DataType, int]:
    """A type as ``schema_of_variant_agg`` writes it, from a place on, and the place behind it."""
    word = re.compile(r"[A-Z]+").match(text, at).group(0)
    at += len(word)
    if word == "ARRAY":
        inner, at = _kind(text, at + 1)
        return T.ArrayType(inner), at + 1
    if word == "OBJECT":
        fields = []
        while text[at] in "<,":
            name = re.compile(r"[<,] ?(?:`((?:[^`]|``)*)`|([^:<>,` ]*)): ").match(text, at)
            if name is None:
                return T.StructType([]), at + 2  # an object without fields
            inner, at = _kind(text, name.end())
            fields.append(T.StructField(name.group(1).replace("``", "`") if name.group(1) is not None else name.group(2), inner))
        return T.StructType(fields), at + 1
    if word == "DECIMAL":
        digits, scale = map(int, re.compile(r"\((\d+),(\d+)\)").match(text, at).groups())
        return T.DoubleType() if scale else T.DecimalType(digits, 0) if digits > 19 else T.LongType(), text.index(")", at) + 1
    return {"BIGINT": T.LongType(), "BOOLEAN": T.BooleanType(), "DOUBLE": T.DoubleType()}.get(word, T.StringType()), at


def infer_json_schema(df: DataFrame, column: str) -> T.StructType:
    """Schema of JSON texts over all rows, by one distributed pass of native aggregates: numbers with a point or an exponent
    are doubles, what differs between rows, or is null in all of them, is a string. Texts that are no objects say nothing."""
    value = F.try_parse_json(F.col(column).cast("string"))
    found = df.select(value.alias("v")).where(F.schema_of_variant("v").like("OBJECT%")).agg(F.schema_of_variant_agg("v")).first()[0]
    kind = _kind(found, 0)[0] if found and found.startswith("OBJECT") else T.StructType([])
    return kind


def parse_json_column(df: DataFrame, column: str, schema: str | T.DataType | None = None, prefix: str = "", drop_source: bool = False) -> DataFrame:
    """Fields of a JSON text as columns; text that isn't JSON gives nulls. Without a schema that of all texts is inferred."""
    kind = infer_json_schema(df, column) if schema is None else schema
    kind = T.StructType.fromDDL(kind) if isinstance(kind, str) else kind
    keep = [c for c in df.columns if not (drop_source and c == column)]
    return df.withColumn("_j", F.from_json(column, kind)).select(*keep, *[F.col("_j")[f.name].alias(f"{prefix}{f.name}") for f in kind.fields])


def extract_json_field(df: DataFrame, column: str, path: str, target: str) -> DataFrame:
    return df.withColumn(target, F.get_json_object(column, path))


def explode_array_column(df: DataFrame, column: str, name: str, keep_position: bool = False) -> DataFrame:
    """A row per element, one with a null for an empty or null array."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode_outer(column).alias("pos", name) if keep_position else F.explode_outer(column).alias(name))


def split_delimited_column(df: DataFrame, column: str, delimiter: str, targets: list[str]) -> DataFrame:
    """Parts of a text by a literal delimiter; missing parts are null."""
    parts = F.split(F.col(column), r"\Q" + delimiter + r"\E")
    return df.withColumns({t: F.try_element_at(parts, F.lit(i + 1)) for i, t in enumerate(targets)})


def flatten_struct_column(df: DataFrame, column: str, sep: str = "_", recursive: bool = False) -> DataFrame:
    """Fields of a struct as columns, nested structs too if ``recursive``."""

    def fields(path: str, kind: T.StructType, name: str) -> list:
        out = []
        for f in kind.fields:
            if recursive and isinstance(f.dataType, T.StructType):
                out += fields(f"{path}.`{f.name}`", f.dataType, f"{name}{sep}{f.name}")
            else:
                out.append(F.col(f"{path}.`{f.name}`").alias(f"{name}{sep}{f.name}"))
        return out

    return df.select(*[c for c in df.columns if c != column], *fields(f"`{column}`", df.schema[column].dataType, column))


def decode_kafka(df: DataFrame, value_format: str = "string", schema: str | None = None, include_metadata: bool = True, include_headers: bool = False) -> DataFrame:
    """Rows of the Kafka schema (key, value, topic, partition, offset, timestamp, headers) decoded; batch or stream."""
    out = [F.col("key").cast("string").alias("key")]
    value = F.col("value").cast("string")
    if value_format == "json":
        out.append(F.from_json(value, schema).alias("_v"))
    elif value_format == "string":
        out.append(value.alias("value"))
    else:
        raise ValueError(f"unknown value format {value_format!r}")
    if include_metadata:
        out += [F.col(c) for c in ("topic", "partition", "offset", "timestamp")]
    if include_headers:
        out.append(F.map_from_entries(F.transform("headers", lambda h: F.struct(h["key"], h["value"].cast("string")))).alias("headers"))
    made = df.select(*out)
    return made.select("*", "_v.*").drop("_v") if value_format == "json" else made


#: What the formats of change envelopes call an insert, update, read and delete.
_OPS = {"c": "c", "u": "u", "r": "r", "d": "d", "insert": "c", "update": "u", "delete": "d", "bootstrap-insert": "r", "replace": "u", "I": "c", "U": "u", "D": "d", "INSERT": "c", "DELETE": "d"}


def parse_cdc_envelope(df: DataFrame, column: str, envelope: str, row_schema: str, keys: list[str], seq: str | None = None) -> DataFrame:
    """Change events as ``(op, key columns, row, seq)``: op is c, u, r or d; ``row`` the image after, or before a delete.

    ``envelope``: debezium, maxwell, mongo, goldengate or snowflake. ``seq`` names another column to order by. An update of
    snowflake is a delete and an insert that say so: the insert is the update, the delete no event.
    """
    j = F.col(column)
    get = lambda p: F.get_json_object(j, p)
    row = lambda p: F.from_json(get(p), row_schema)
    forms = {
        "debezium": (get("$.op"), F.coalesce(row("$.after"), row("$.before")), get("$.ts_ms")),
        "maxwell": (get("$.type"), row("$.data"), get("$.ts")),
        "mongo": (get("$.operationType"), F.coalesce(row("$.fullDocument"), row("$.documentKey")), get("$.clusterTime")),
        "goldengate": (get("$.op_type"), F.coalesce(row("$.after"), row("$.before")), get("$.pos")),
        "snowflake": (F.get_json_object(j, "$['METADATA$ACTION']"), F.from_json(j, row_schema), get("$.seq")),
    }
    if envelope not in forms:
        raise ValueError(f"unknown envelope {envelope!r}")
    op, image, order = forms[envelope]
    if envelope == "snowflake":
        updates = F.coalesce(F.lower(get("$['METADATA$ISUPDATE']")) == "true", F.lit(False))
        df = df.where(~(updates & (F.upper(op) == "DELETE")))
        op = F.when(updates, F.lit("u")).otherwise(op)
    ops = F.create_map(*[F.lit(x) for kv in _OPS.items() for x in kv])
    made = df.select(F.try_element_at(ops, op).alias("op"), image.alias("row"), (F.col(seq) if seq else order.try_cast("long")).alias("seq"))
    return made.select("op", *[F.col(f"row.{k}").alias(k) for k in keys], "row", "seq")
