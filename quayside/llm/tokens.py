"""Words and shingles of whole texts, as arrays.

The operators of this package get Arrow batches from Spark (``mapInArrow``). The helpers here cut a batch into slices of
bounded size and turn the UTF-8 bytes of a slice into word boundaries and 64-bit word hashes, without a Python loop over
words. A single text longer than the slice bound makes a slice of its own, so no text is ever cut.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 18
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_DIRECT = 64  # bytes of a word that are hashed by array steps; the rest of a longer word goes to xxhash


def _lowered(word: np.ndarray) -> np.ndarray:
    """Byte to lower-cased byte (A-Z only), 0 for bytes between words."""
    low = np.arange(256, dtype=np.uint8)
    low[ord("A") : ord("Z") + 1] += 32
    return np.where(word[low], low, 0).astype(np.uint8)


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Lower-cased letters, digits and everything beyond ASCII: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = _lowered(_byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)))
#: Everything but ASCII white space: ``[^\x20\x09-\x0D]+``. Byte 0 belongs to words here, so the table is a pair.
_SPACE = _byte_set((0x20, 0x20), (0x09, 0x0D))


def bound_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of at most BATCH_ROWS rows and about BATCH_BYTES (the session's defaults are for
    narrow rows; a batch of whole texts takes its size several times over, in the JVM's buffers and in the worker)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def column(name: str) -> Column:
    """The column of this name, whatever signs the name has."""
    return F.col(f"`{name.replace('`', '``')}`")


def row_and_text(docs: DataFrame, text_col: str) -> DataFrame:
    """``doc``, a struct of all columns, and ``text``, the text as a string."""
    return docs.select(F.struct(*map(column, docs.columns)).alias("doc"), column(text_col).cast("string").alias("text"))


def schema(rows: DataFrame, name: str, more: str) -> StructType:
    """The column ``name`` of ``rows`` as it is there, then the columns that ``more`` declares."""
    return StructType([rows.schema[name], *StructType.fromDDL(more).fields])


def unused_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores before it as set it apart from the names taken."""
    while name.lower() in {x.lower() for x in taken}:
        name = f"_{name}"
    return name


class Words:
    """Words of a slice: ``starts``/``ends`` (bytes in ``low``), ``offsets`` (word numbers at which documents begin)."""

    def __init__(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray):
        self.low, self.starts, self.ends, self.offsets = low, starts, ends, offsets

    def hashes(self) -> np.ndarray:
        return hash_spans(self.low, self.starts, self.ends)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``most`` bytes each, one row at least."""
    lengths = np.diff(_offsets(column))
    a, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > most:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(lengths):
        yield a, len(lengths)


def filled(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column without nulls (null: empty), in one chunk with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (from 0) of a column made by ``filled``."""
    off = _offsets(column)
    body = column.buffers()[2] if len(column) else None
    data = np.frombuffer(body, dtype=np.uint8)[off[0] : off[-1]] if body is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def _spans(inside: np.ndarray, low: np.ndarray, offsets: np.ndarray) -> Words:
    first = np.zeros(len(inside) + 1, dtype=bool)
    first[offsets] = True  # a document's first byte begins a word even if the byte before it, of another text, is in one
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return Words(low, starts, ends, np.searchsorted(starts, offsets))


def alnum_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of texts whose A-Z are lower-cased."""
    low = ALNUM[data]
    return _spans(low != 0, low, offsets)


def space_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts whose A-Z are lower-cased."""
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    return _spans(~_SPACE[data], low, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    h = (h ^ (h >> _S30)) * _M1
    h = (h ^ (h >> _S27)) * _M2
    return h ^ (h >> _S31)


def hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; equal bytes give equal hashes wherever they stand."""
    n = ends - starts
    h = n.astype(np.uint64) * _M3
    if not len(n):
        return h
    padded = np.concatenate((low, np.zeros(8, np.uint8)))
    at = np.ndarray((len(low) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = mix(h ^ (at[starts] & _LOW_BYTES[np.minimum(n, 8)]))
    k = 8
    rest = np.flatnonzero(n > k)
    while len(rest) and k < _DIRECT:
        h[rest] = mix(h[rest] ^ (at[starts[rest] + k] & _LOW_BYTES[np.minimum(n[rest] - k, 8)]) + _M3)
        k += 8
        rest = rest[n[rest] > k]
    for i in rest.tolist():
        h[i] = np.uint64(xxhash.xxh3_64_intdigest(low[starts[i] + k : ends[i]].tobytes(), int(h[i])))
    return h


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on that has so many (documents are not looked at)."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = out * _M1 + h[j : len(h) - n + 1 + j]
    return mix(out + np.uint64(n))


def sequence_hash(h: np.ndarray) -> np.ndarray:
    """Hash of a whole (short) word sequence, as ``ngram_hashes`` of its length would give."""
    return ngram_hashes(h, len(h))


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its ``n``-word shingles; fewer words: of the whole sequence."""
    h = words.hashes()
    grams = ngram_hashes(h, n)
    out = []
    off = words.offsets.tolist()
    for a, b in zip(off, off[1:]):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
        else:
            out.append(sequence_hash(h[a:b]) if b > a else h[:0])
    return out


def has_letter(text: str) -> bool:
    """Does any character have a Unicode letter category?"""
    return any(c.isalpha() or unicodedata.category(c)[0] == "L" for c in text)


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of numpy arrays."""
    sizes = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
    off = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, type=kind))
