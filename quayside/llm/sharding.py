"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 to N - 1 in the order of their ids. A balanced Feistel network over the smallest even number of bits
that holds N permutes the numbers of that many bits; a number that lands beyond N - 1 is permuted again until it does not
(cycle walking), which makes a permutation of 0 to N - 1. The shuffled place of a row, and so its shard (place modulo
shards) and its slot there (place divided by shards), follow from its number, N and the seed alone; ``feistel_inverse``
gives the row of any shard and slot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm import tokens as T
from quayside.operators.enrichment import number_rows

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, -(-max(1, n - 1).bit_length() // 2))


def _round(x: np.ndarray, key: int, half: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) & np.uint64((1 << half) - 1)


def _keys(seed: int) -> list[int]:
    return np.random.default_rng(seed).integers(0, 2**62, ROUNDS).tolist()


def feistel(numbers: np.ndarray, n: int, seed: int, *, inverse: bool = False) -> np.ndarray:
    """The permutation of 0 to n - 1, or its inverse, at the given numbers."""
    half = _half_bits(n)
    low = np.uint64((1 << half) - 1)
    keys = _keys(seed)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        a, b = x >> np.uint64(half), x & low
        for k in reversed(keys) if inverse else keys:
            if inverse:
                a, b = b ^ _round(a, k, half), a
            else:
                a, b = b, a ^ _round(b, k, half)
        out[todo] = (a << np.uint64(half)) | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def feistel_inverse(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Row numbers of shuffled places."""
    return feistel(places, n, seed, inverse=True)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 40, seed: int = 8) -> DataFrame:
    """``id, size, text_crc32, row, place, shard, slot`` for each row; counts of shards are at most one apart.

    ``size`` is the UTF-8 length of the text (null: none) plus 16. Null ids come first; rows of one id are put in order by
    their text's checksum and size, so only rows equal in all of these are interchangeable. An empty table gives no rows.
    Other columns are not looked at.
    """
    text = F.coalesce(T.column(text_col).cast("string"), F.lit(""))
    slim = docs.select(T.column(id_col).alias("id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = number_rows(slim, ["id", "text_crc32", "size"], "row")
    n = rows.count()

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(feistel(row.to_numpy(np.int64), max(n, 1), seed))

    placed = rows.withColumn("place", place("row"))
    return placed.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.expr(f"place div {shards}"))


def op8_feistel_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    put = shard_documents(docs)
    return put.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
