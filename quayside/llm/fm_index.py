"""Benchmark decontamination with an FM-index per training shard.

Each task cuts its texts into shards of a bounded size and indexes every shard as one sequence of word
numbers, documents being kept apart by an end mark: suffix order, Burrows-Wheeler transform, a wavelet tree over it for
ranks, and the suffix positions of every ``SAMPLE``-th place. Test phrases (windows of benchmark words) are searched
backwards, all at once; occurrences are located by walking to the next sampled place, and the spans of one document are
merged into removal spans.

An index is kept cheap without leaving anything out that could match: words that no phrase has are one symbol, which is
never searched for, and a run of them stands once; equal texts of a shard are indexed once and reported each.

The phrases go to the executors in blocks of bounded size; if there is more than one block, the texts are read once per
block. So neither the driver nor an executor holds more than a block, however long the benchmark is. A single item longer
than a block makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.scratch import materialize
from quayside.llm import tokens as T

SHARD_BYTES = 2 << 20  # some 350,000 words; a longer text makes a shard of its own
SAMPLE = 16
BLOCK_ITEMS = 20_000  # benchmark items a block; their texts are bounded by BLOCK_BYTES as well
BLOCK_BYTES = 4 << 20  # some 700,000 windows, 30 MB as word numbers


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector a level, each with counts of ones every 64 places."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n = len(seq)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = seq.astype(np.uint32 if sigma > 65536 else np.uint16)
        for level in range(self.levels - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(8 + (-len(packed)) % 8, np.uint8))).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed)))).astype(np.int64))
            self.zeros.append(int(self.n - bit.sum()))
            cur = np.concatenate((cur[~bit], cur[bit]))

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][w] + np.bitwise_count(self.words[level][w] & mask).astype(np.int64)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, hi = np.zeros_like(i), i.copy()
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before it."""
        symbol, lo, at = np.zeros_like(i), np.zeros_like(i), i.copy()
        for k in range(self.levels):
            one = ((self.words[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            a, b = self._ones(k, lo), self._ones(k, at)
            symbol = symbol * 2 + one
            lo = np.where(one, self.zeros[k] + a, lo - a)
            at = np.where(one, self.zeros[k] + b, at - b)
        return symbol, at - lo


class FMIndex:
    """Index of a sequence of symbols below ``sigma`` that symbol 0, which stands nowhere else, ends."""

    def __init__(self, seq: np.ndarray, sigma: int):
        n = len(seq)
        order = _suffix_order(seq, sigma)
        self.tree = WaveletTree(seq[order - 1], sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma)))).astype(np.int64)
        sampled = order % SAMPLE == 0
        self.sampled = WaveletTree(sampled.astype(np.uint8), 2)
        self.positions = order[sampled].astype(np.int64)
        self.n = n

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases (rows, padded on the right), by backward search."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((j < lengths) & (hi > lo))
            if len(live):
                c = phrases[live, j].astype(np.int64)
                lo[live] = self.first[c] + self.tree.rank(c, lo[live])
                hi[live] = self.first[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by stepping back to the nearest sampled one."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            hit, before = self.sampled.access_rank(at)
            done = hit == 1
            out[todo[done]] = self.positions[before[done]] + steps
            todo, at = todo[~done], at[~done]
            symbol, before = self.tree.access_rank(at)
            at, steps = self.first[symbol] + before, steps + 1
        return out


def _suffix_order(seq: np.ndarray, sigma: int) -> np.ndarray:
    """Order of all suffixes, by prefix doubling from as many symbols as fit into 62 bits; later rounds look at ties only."""
    n = len(seq)
    bits = max(1, int(sigma - 1).bit_length())
    k = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate((seq, np.zeros(k, seq.dtype))).astype(np.int64)
    for j in range(k):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key)
    by = key[order]
    rank = np.empty(n, np.int64)
    new = np.concatenate(([True], by[1:] != by[:-1]))
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = _with_equals(~new)
    while len(tied):
        suffix = order[tied]
        key = rank[suffix] * np.int64(n) + rank[np.minimum(suffix + k, n - 1)]
        at = np.argsort(key)
        order[tied] = suffix = suffix[at]
        key = key[at]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[suffix] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[_with_equals(~new)]
        k *= 2
    return order


def _with_equals(same: np.ndarray) -> np.ndarray:
    """Places that equal the one before or after them."""
    both = same.copy()
    both[:-1] |= same[1:]
    return np.flatnonzero(both)


class Phrases:
    """Windows of a block of benchmark items: distinct rows of word numbers, their lengths, and the items that have them."""

    def __init__(self, item_ids: list, texts: list[str | None], window: int):
        words = T.alnum_words(*T.utf8(T.filled(pa.array(texts, pa.string()))))
        h, off = words.hashes(), words.offsets
        self.vocabulary, number = np.unique(h, return_inverse=True)
        n = np.diff(off)
        windows = np.where(n > 0, np.maximum(n - window, 0) + 1, 0)
        owner = np.repeat(np.arange(len(n)), windows)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + off[:-1][owner]
        number = np.concatenate((number + FIRST_WORD, np.zeros(window, np.int64))).astype(np.int32)
        table = np.lib.stride_tricks.sliding_window_view(number, window)[start]
        for j in range(window):
            table[start + j >= off[1:][owner], j] = 0
        rows, of = np.unique(table.view(np.dtype((np.void, 4 * window)))[:, 0], return_inverse=True)
        self.rows = rows.view(np.int32).reshape(-1, window)
        self.lengths = (self.rows > 0).sum(axis=1)
        by = np.argsort(of, kind="stable")
        self.items = owner[by]
        self.item_offsets = np.searchsorted(of[by], np.arange(len(self.rows) + 1))
        self.ids = [None if x is None else str(x) for x in item_ids]


#: Symbols of a shard: its end, the end of a document, a run of words that no phrase has; then the phrases' words.
END, DOCUMENT_END, OTHER, FIRST_WORD = 0, 1, 2, 3


def _shard(words: T.Words, texts: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a shard's distinct texts, the word at which each symbol stands, and the text that it belongs to."""
    h = words.hashes()
    at = np.searchsorted(phrases.vocabulary, h)
    at[at == len(phrases.vocabulary)] = 0
    symbol = np.where(phrases.vocabulary[at] == h, at + FIRST_WORD, OTHER)
    n_docs = len(words.offsets) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(words.offsets))
    keep = texts[doc]
    first = np.zeros(len(h) + 1, bool)
    first[words.offsets] = True
    run = (symbol[1:] == OTHER) & (symbol[:-1] == OTHER) & ~first[1:-1] if len(h) > 1 else np.zeros(0, bool)
    keep = keep & ~np.concatenate((np.zeros(min(1, len(h)), bool), run))
    ends = np.flatnonzero(texts)
    word = np.concatenate((np.flatnonzero(keep), words.offsets[1:][ends]))
    symbol = np.concatenate((symbol[keep], np.full(len(ends), DOCUMENT_END)))
    owner = np.concatenate((doc[keep], ends))
    by = np.lexsort((word, owner))
    return np.concatenate((symbol[by], [END])), np.concatenate((word[by], [0])), np.concatenate((owner[by], [0]))


def _search(text: pa.Array, phrases: Phrases) -> tuple[T.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice, and for each occurrence its document, first word, length in words and phrase.

    Equal texts of a slice are indexed once; their occurrences are given for each.
    """
    words = T.alnum_words(*T.utf8(text))
    none = np.zeros(0, np.int64)
    codes = text.dictionary_encode()
    code = codes.indices.to_numpy()
    _, leader = np.unique(code, return_index=True)
    if not len(words.starts) or not len(phrases.rows):
        return words, none, none, none, none
    lead = np.zeros(len(text), bool)
    lead[leader] = True
    symbols, word, owner = _shard(words, lead, phrases)
    index = FMIndex(symbols, FIRST_WORD + len(phrases.vocabulary))
    lo, hi = index.ranges(phrases.rows, phrases.lengths)
    count = hi - lo
    which = np.repeat(np.arange(len(lo)), count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    at = index.locate(rows)
    doc, start = owner[at], word[at] - words.offsets[owner[at]]
    by_doc = np.argsort(doc, kind="stable")
    doc, start, which = doc[by_doc], start[by_doc], which[by_doc]
    leader_of = leader[code]
    begin, end = np.searchsorted(doc, leader_of), np.searchsorted(doc, leader_of, side="right")
    times = end - begin
    pick = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin, times)
    return words, np.repeat(np.arange(len(text)), times), start[pick], phrases.lengths[which[pick]], which[pick]


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of word intervals, sorted."""
    by = np.argsort(start, kind="stable")
    start, reach = start[by], np.maximum.accumulate(end[by])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))
    return start[new], reach[last]


def _scan(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """``(doc, text)`` to ``(doc, n_words, items, spans)``; spans are word starts and ends, byte starts and ends in turn."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    T.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            text = T.filled(batch.column(1))
            for a, b in T.slices(text, SHARD_BYTES):
                words, doc, start, length, which = _search(text.slice(a, b - a), p)
                byte0 = T.utf8(text.slice(a, b - a))[1]
                bounds = np.searchsorted(doc, np.arange(b - a + 1))
                items, spans = [], []
                for i in range(b - a):
                    lo, hi = bounds[i], bounds[i + 1]
                    if lo == hi:
                        items.append([])
                        spans.append([])
                        continue
                    owners = {p.ids[k] for w in np.unique(which[lo:hi]) for k in p.items[p.item_offsets[w] : p.item_offsets[w + 1]]}
                    items.append(sorted(x for x in owners if x is not None))
                    s, e = _merged(start[lo:hi], start[lo:hi] + length[lo:hi])
                    w0 = words.offsets[i]
                    spans.append([{"start": int(x), "end": int(y), "first_byte": int(words.starts[w0 + x] - byte0[i]), "last_byte": int(words.ends[w0 + y - 1] - byte0[i])} for x, y in zip(s, e)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(words.offsets).astype(np.int64)), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)],
                    names=["doc", "n_words", "items", "spans"],
                )

    return docs.mapInArrow(run, T.schema(docs, "doc", f"n_words long, items array<string>, spans {SPANS}"))


SPANS = "array<struct<start:bigint,end:bigint,first_byte:bigint,last_byte:bigint>>"
_SPANS = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "end", "first_byte", "last_byte")]))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[tuple[Phrases, int]]:
    """Phrases of the benchmark, at most BLOCK_ITEMS items or about BLOCK_BYTES at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    k = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for b in range(k):
        some = items if k == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(k)) == b)
        got = some.toPandas()
        yield Phrases(got["id"].tolist(), got["text"].tolist(), window), k


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", *, item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """Every place where ``window`` consecutive words of a benchmark item stand in a text.

    Returns one row per row of ``docs``: ``doc`` (struct of its columns), ``n_words``, ``items`` (ids as strings, sorted,
    distinct) and ``spans`` (merged removal spans, as words and as UTF-8 bytes). Words are those of ``alnum_words``. An
    item of fewer words, but not none, is one window. Null and empty texts have no words; repeated rows are reported each;
    empty tables give no rows or no spans; null item ids hit words but name no item. Columns of ``docs`` keep their names
    inside ``doc``, whatever they are.
    """
    packed = T.row_and_text(docs, text_col)
    parts, phrases, k = [], None, 1
    for phrases, k in _blocks(benchmark, item_col, item_text_col, window):
        if k == 1:
            return _scan(packed, phrases)
        if not parts:
            packed = materialize(packed.select(F.struct(F.monotonically_increasing_id().alias("row"), "doc").alias("doc"), "text"), "numbered")
        parts.append(materialize(_scan(packed, phrases).select(F.col("doc.row").alias("row"), "n_words", "items", "spans"), "leaks"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    joined = every.groupBy("row").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return packed.select("doc.row", "doc.doc").join(joined, "row").select("doc", "n_words", "items", F.expr(_MERGE).alias("spans"))


_MERGE = f"""aggregate(spans, cast(array() as {SPANS}), (done, s) ->
  case when size(done) > 0 and s.start <= element_at(done, -1).end then concat(slice(done, 1, size(done) - 1), array(named_struct(
    'start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end),
    'first_byte', element_at(done, -1).first_byte, 'last_byte', greatest(element_at(done, -1).last_byte, s.last_byte))))
  else concat(done, array(s)) end)"""


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the removal spans; a text of which no word is left goes, one without any word before stays.

    A span gives way to a line break. What stood on its two sides could then form a window of its own, so texts that were
    cut are searched again until none has a hit; each round takes words out of each text it looks at, and only texts that
    were cut in the round before are looked at.
    """
    columns = docs.columns

    T.bound_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = []
            for t, ss in zip(texts, spans):
                raw, parts, at = (t or "").encode(), [], 0
                for s in ss:
                    parts.append(raw[at : s["first_byte"]])
                    at = s["last_byte"]
                out.append(b"\n".join([*parts, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(3)], names=["doc", "cut", "left"])

    left = F.col("n_words") - F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    clean, current = None, docs
    while True:
        found = materialize(find_leaks(current, benchmark, text_col, **how), "found")
        whole = found.where("size(spans) = 0").select("doc.*")
        clean = whole if clean is None else clean.unionByName(whole)
        hit = found.where("size(spans) > 0")
        if hit.isEmpty():
            return clean
        pieces = hit.select("doc", F.col("doc").getField(text_col).cast("string").alias("text"), "spans", left.alias("left")).mapInArrow(cut, T.schema(found, "doc", "cut string, left long"))
        # Written first: cutting and searching in one task would need two Python workers.
        current = materialize(pieces.where("left > 0").select([F.col("cut").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in columns]), "cut")


def op10_fm_decontamination(spark, sf_dir: str) -> DataFrame:
    """Ten-word windows of the benchmark in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT item_id, list_aggregate(ws[i:i + 9], 'string_agg', ' ') AS g, len(ws[i:i + 9]) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, least(len(ws), 1)) + 1)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, list_aggregate(ws[i:i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
o AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
