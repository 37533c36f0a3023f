"""Packing of tokenised documents into sequences of a fixed length.

Tokens. Byte-level BPE merges nothing across the pieces that its splitting pattern makes, so the ids of a text are those
of its pieces in a row. The pieces are found with array steps over the code points of a slice of texts; each distinct
piece is given to the tokenizer once and kept in a table of bounded size. Texts with code points beyond the basic plane
or with one of the vocabulary's added tokens go to the tokenizer whole.

Packing. A document is cut into full pieces, which make sequences of their own, and a rest. Documents are dealt to groups
at random with their rests (a number of groups in proportion to the rows, so a group stays as small at any input size),
and each group is packed by first-fit decreasing: the leftmost bin with room is found by walking down a tournament tree of
the bins' free space.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.scratch import materialize
from quayside.llm import tokens as T

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
GROUP_ROWS = 8192
_KNOWN_MOST = 400_000  # distinct pieces that a worker keeps; then it begins anew
_SLICE = 512 << 10


def _classes() -> np.ndarray:
    """Class of each code point of the basic plane: letters L*, numbers N*, white space, anything else."""
    out = np.full(0x10000, OTHER, np.uint8)
    for i in range(0x10000):
        kind = unicodedata.category(chr(i))
        if kind[0] == "L":
            out[i] = LETTER
        elif kind[0] == "N":
            out[i] = NUMBER
        elif kind[0] == "Z" or 9 <= i <= 13 or i == 0x85:
            out[i] = SPACE
    return out


def split_points(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes at which pieces begin, and for each document whether it has code points beyond the basic plane.

    The pattern: ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|\\s+(?!\\S)|\\s+``.
    """
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[lead].astype(np.int32)
    point = b.copy()
    two, three, four = np.flatnonzero((b >= 0xC0) & (b < 0xE0)), np.flatnonzero((b >= 0xE0) & (b < 0xF0)), np.flatnonzero(b >= 0xF0)
    tail = lambda rows, k: data[lead[rows] + k].astype(np.int32) & 0x3F
    point[two] = ((b[two] & 0x1F) << 6) | tail(two, 1)
    point[three] = ((b[three] & 0x0F) << 12) | (tail(three, 1) << 6) | tail(three, 2)
    point[four] = 0
    kind = classes[point]
    n = len(lead)
    far = np.zeros(len(offsets) - 1, bool)
    far[np.searchsorted(offsets, lead[four], side="right") - 1] = True
    doc_start = np.zeros(n + 1, bool)
    doc_start[np.searchsorted(lead, offsets)] = True
    new = doc_start[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    # The last white space before something else: a piece of its own, or, a blank, the head of what follows.
    before = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~doc_start[1:-1]) if n else np.zeros(0, np.int64)
    new[before] = True
    blank = point[before] == 32
    new[before[blank] + 1] = False
    # Contractions, where a piece begins with the apostrophe.
    quote = np.flatnonzero((point == 39) & new)
    for q in quote.tolist():
        word = "".join(map(chr, point[q + 1 : q + 3].tolist()))
        for tail_ in ("s", "t", "re", "ve", "m", "ll", "d"):
            end = q + 1 + len(tail_)
            if word.startswith(tail_) and not doc_start[q + 1 : end].any():
                new[q + 1] = False
                if end < n:
                    new[end] = True
                break
    return lead[new], far


class Pieces:
    """Ids of pieces seen so far, by the hash of their bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = _classes()
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.starts, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _keep(self, hashes: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Take new pieces into the kept table, which is emptied before it would grow beyond its bound."""
        if len(self.hashes) + len(hashes) > _KNOWN_MOST:
            self._forget()
        if len(hashes) > _KNOWN_MOST:
            return
        every = np.concatenate((self.hashes, hashes))
        by = np.argsort(every, kind="stable")
        starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.hashes, self.starts, self.sizes = every[by], starts[by], np.concatenate((self.sizes, sizes))[by]
        self.flat = np.concatenate((self.flat, flat))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each document, without an end mark."""
        begin, whole = split_points(data, offsets, self.classes)
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                whole[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(token, at + 1)
        end = np.concatenate((begin[1:], [len(data)])) if len(begin) else begin
        distinct, where, inverse = np.unique(T.hash_spans(data, begin, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~known)
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([raw[begin[i] : end[i]].decode() for i in where[new].tolist()], add_special_tokens=False)]
        # The slice's own table: the kept ids, as they are now, and the new ones after them.
        starts, sizes = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        starts[known], sizes[known] = self.starts[at[known]], self.sizes[at[known]]
        sizes[new] = np.fromiter(map(len, ids), np.int64, len(ids))
        starts[new] = len(self.flat) + np.cumsum(sizes[new]) - sizes[new]
        added = np.fromiter((x for i in ids for x in i), np.uint32, int(sizes[new].sum()))
        table = np.concatenate((self.flat, added))
        start, size = starts[inverse], sizes[inverse]
        sums = np.concatenate(([0], np.cumsum(size)))
        flat = table[np.arange(sums[-1]) - np.repeat(sums[:-1], size) + np.repeat(start, size)]
        self._keep(distinct[new], sizes[new], added)
        bounds = sums[np.searchsorted(begin, offsets)]
        out = [flat[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
        for i in np.flatnonzero(whole).tolist():
            text = raw[offsets[i] : offsets[i + 1]].decode()
            out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return out


_held: dict[str, Pieces] = {}  # a Python worker serves many tasks


def _pieces_of(path: str) -> Pieces:
    if path not in _held:
        _held[path] = Pieces(path)
    return _held[path]


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Longest first, equal lengths in the order given; each into the leftmost bin with
    room. The tournament tree holds in each node the most free space of the bins below it; all bins begin empty, so
    the tree as wide as the items always has one."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    width = 1 << max(0, (n - 1).bit_length())
    free = [capacity] * (2 * width)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, node = int(lengths[i]), 1
        while node < width:
            node *= 2
            if free[node] < size:
                node += 1
        bins[i], offsets[i] = node - width, capacity - free[node]
        free[node] -= size
        node >>= 1
        while node:
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
            node >>= 1
    return bins, offsets


def document_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, length: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Documents as token pieces of at most ``length``: ``id, start, length, ids_crc32, doc_tokens`` and, if asked for,
    ``ids``. The ids of a document are those of its text (null: none) and ``end_id``; its pieces hold each once."""

    T.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _pieces_of(vocabulary)
        for batch in batches:
            text = T.filled(batch.column(1))
            for a, b in T.slices(text, _SLICE):
                row, start, size, crc, total, kept = [], [], [], [], [], []
                for i, ids in enumerate(coder.ids(*T.utf8(text.slice(a, b - a)))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(ids), length):
                        piece = ids[s : s + length]
                        row.append(a + i)
                        start.append(s)
                        size.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(ids))
                        if with_ids:
                            kept.append(piece.astype(np.int32))
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns, names = [*columns, T.list_column(kept, pa.int32())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(T.column(id_col).alias("id"), T.column(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, *, capacity: int = 1024, group_rows: int = GROUP_ROWS, seed: int = 17) -> DataFrame:
    """``pieces`` (any columns, one of them ``length``) with ``sequence_id`` and ``offset``.

    A piece of ``capacity`` is a sequence of its own, with a negative number. The others, one a document, are dealt at
    random to groups of about ``group_rows`` rows and go through first-fit decreasing there; equal lengths go in the order
    written. The pieces are written first, so that a task that runs again deals its rows as before. Repeated rows are packed
    each; columns keep their names, those of this function excepted; an empty table gives an empty result; a length beyond
    ``capacity`` is an error.
    """
    held = materialize(pieces.select(F.struct(*map(T.column, pieces.columns)).alias("piece"), F.col("length").cast("long").alias("n"), F.monotonically_increasing_id().alias("k")), "pieces")
    rests = held.where(F.col("n") != capacity)
    groups = max(1, -(-rests.count() // group_rows))
    dealt = rests.withColumn("g", F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(groups)))

    def fit(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("n", "descending"), ("k", "ascending")])
        sizes = table["n"].to_numpy()
        if (sizes > capacity).any():
            raise ValueError(f"a piece is longer than {capacity}")
        bins, offsets = first_fit_decreasing(sizes, capacity)
        ids = (table["g"].to_numpy() << 32) | bins
        return pa.table({"piece": table["piece"], "sequence_id": ids, "offset": offsets})

    packed = dealt.groupBy("g").applyInArrow(fit, T.schema(held, "piece", "sequence_id long, offset long"))
    full = held.where(F.col("n") == capacity).select("piece", (-1 - F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full).select("piece.*", "sequence_id", "offset")


def assembled(packed: DataFrame, *, capacity: int = 1024, pad_id: int = 0) -> DataFrame:
    """Sequences of ids, padded to ``capacity``: ``sequence_id, ids, used``. Needs pieces made with ``with_ids``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    return parts.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size(ids))).alias("ids"), F.size(ids).alias("used"))


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, length: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """All documents as pieces with their sequences: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is its end mark alone. Ids may repeat or be null; repeated rows are packed each. Rests of one
    length go in the order in which the pieces were written. Other columns, whatever their names, are not looked at.
    """
    return pack(document_pieces(docs, vocabulary, id_col, text_col, length=length, end_id=end_id, with_ids=with_ids), capacity=length)


def public_vocabulary() -> str:
    """Path of the byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_ffd_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_vocabulary()).withColumnRenamed("id", "doc_id")
