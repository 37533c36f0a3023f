"""Word vectors of a vocabulary that no process holds: skip-grams with negative samples, trained text by text in tasks.

Words are known by 64-bit hashes. A task starts each word it meets with the same vector as any other task would, trains on
its own texts, and gives back the words it met; a word's vector is the mean over tasks, weighted by its occurrences there.
A task holds the words of its own texts, the driver none but the most frequent ones for ``mean_vectors``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.scratch import discard, materialize

WINDOW, NEGATIVES, DRAWN, ALPHA = 5, 5, 32, 0.025
#: Tokens whose pairs are trained at once, and the most occurrences of a word that count in full there.
SLICE, FULL = 2048, 16
#: Words whose vectors every task of ``mean_vectors`` holds; the others are met in blocks of BLOCK words, PART tokens at a time.
FREQUENT, BLOCK, PART = 1 << 17, 1 << 19, 1 << 25


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Python gets whole texts in batches of some MB meanwhile; the session's default counts rows alone."""
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
    kept = {key: spark.conf.get(key) for key in most}
    for key, value in most.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def _slices(batch: pa.RecordBatch, most: int = 1 << 16) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch, whose first column is a list of words, in slices of about ``most`` words, with ``(names, code, row)``:
    the hashes of the distinct words, and of each word that is not null its place there and its row."""
    piece = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy()) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        some = batch.slice(a, b - a)
        flat, row = pc.list_flatten(some.column(0)), pc.list_parent_indices(some.column(0)).to_numpy().astype(np.int64)
        held = flat.is_valid()
        coded = flat.filter(held).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
        names = pd.util.hash_array(words, categorize=False).view(np.int64) if len(words) else np.zeros(0, np.int64)
        yield some, names, coded.indices.to_numpy(), row[held.to_numpy(zero_copy_only=False)]


def _first_vectors(names: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Of each hash ``size`` even numbers around 0, the same in every task."""
    with np.errstate(over="ignore"):
        z = names.view(np.uint64)[:, None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (((z >> np.uint64(40)).astype(np.float32) / (1 << 24) - 0.5) / size).astype(np.float32)


def _step(ids: np.ndarray, doc: np.ndarray, x: np.ndarray, y: np.ndarray, noise: np.ndarray, alpha: float, rng: np.random.Generator) -> None:
    """Train on the pairs of a slice of tokens. ``x``, ``y``: vectors of words as contexts and as centres."""
    xs, ys, alpha = x[ids], y[ids], np.float32(alpha)
    to_x, to_y, met = np.zeros_like(xs), np.zeros_like(ys), np.zeros(len(ids), np.float32)
    reach = rng.integers(1, WINDOW + 1, len(ids))
    for d in range(1, min(WINDOW, len(ids) - 1) + 1):
        same = doc[d:] == doc[:-d]
        for centre, other in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
            on = (same & (reach[centre] >= d)).astype(np.float32)
            gain = (alpha * on / (1 + np.exp(np.einsum("ij,ij->i", xs[other], ys[centre]))))[:, None]
            to_x[other] += gain * ys[centre]
            to_y[centre] += gain * xs[other]
            met[other] += on
    drawn = noise[rng.integers(0, len(noise), DRAWN)]
    against = y[drawn]
    loss = (-alpha * NEGATIVES / DRAWN) * met[:, None] / (1 + np.exp(-(xs @ against.T)))
    to_x += loss @ against
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    names, full = ids[order[first]], np.minimum(1, FULL / np.diff(np.append(first, len(ids)))).astype(np.float32)[:, None]
    x[names] += np.add.reduceat(to_x[order], first) * full
    y[names] += np.add.reduceat(to_y[order], first) * full
    np.add.at(y, drawn, (loss.T @ xs) * np.float32(min(1, FULL * DRAWN / max(1, NEGATIVES * met.sum()))))


def train(tokens: DataFrame, size: int, seed: int, min_count: int) -> DataFrame:
    """``(h, n, v)``: hash, occurrences and vector of each word with at least ``min_count``; each partition of ``tokens``, a
    column of word lists, is trained on its own. Rarer words are contexts, but get no vector."""
    column = tokens.columns[0]
    share = max(1, (tokens.agg(F.sum(F.greatest(F.size(column), F.lit(0)))).first()[0] or 0) // tokens.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        place: dict[int, int] = {}
        x, y, n, seen = np.zeros((0, size), np.float32), np.zeros((0, size), np.float32), np.zeros(0, np.int64), 0
        for _, names, code, doc in (s for batch in batches for s in _slices(batch)):
            if not len(names):
                continue
            count = np.bincount(code)
            at = np.array([place.setdefault(h, len(place)) for h in names.tolist()])
            if len(place) > len(x):
                more = max(len(place), len(x) * 3 // 2) - len(x)
                x, y, n = (np.concatenate([v, np.zeros((more, *v.shape[1:]), v.dtype)]) for v in (x, y, n))
            new = n[at] == 0
            x[at[new]] = _first_vectors(names[new], size, seed)
            n[at] += count
            weight = np.cumsum(count**0.75)
            noise = at[np.searchsorted(weight, rng.random(1 << 14) * weight[-1])]
            ids = at[code]
            for a in range(0, len(ids), SLICE):
                _step(ids[a : a + SLICE], doc[a : a + SLICE], x, y, noise, ALPHA * max(1e-4, 1 - (seen + a) / share), rng)
            seen += len(ids)
        names = np.fromiter(place, np.int64, len(place))
        for a in range(0, len(names), 8192):
            held = x[a : min(a + 8192, len(names))]
            v = pa.ListArray.from_arrays(np.arange(0, held.size + 1, size, dtype=np.int32), held.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 8192]), pa.array(n[a : a + len(held)]), v], names=["h", "n", "v"])

    made = tokens.mapInArrow(run, "h long, n long, v array<float>")
    sums = [F.sum(F.col("n") * F.col("v")[k].cast("double")).alias(f"s{k}") for k in range(size)]
    whole = made.groupBy("h").agg(F.sum("n").alias("n"), *sums).where(F.col("n") >= min_count)
    with _small_batches(tokens.sparkSession):
        return materialize(whole.select("h", "n", F.array(*[(F.col(f"s{k}") / F.col("n")).cast("float") for k in range(size)]).alias("v")), "words")


def mean_vectors(df: DataFrame, tokens: str, vectors: DataFrame, size: int, target: str) -> DataFrame:
    """``df`` with the mean of its words' vectors, words without one counting as 0, as does a list without words.

    The FREQUENT most frequent words are added up where a list is read; the hashes of the others are dealt to blocks of
    words, and what a list's words give is added up by its own hash of 128 bits.
    """
    level = F.floor(F.log2("n") * 8)
    sizes = vectors.groupBy(level.alias("level")).agg(F.count("*").alias("n")).toPandas().sort_values("level", ascending=False)  # some hundred rows at most
    least = sizes["level"][sizes["n"].cumsum() <= FREQUENT].min()
    top = vectors.where(level >= (1000 if np.isnan(least) else int(least))).toPandas().sort_values("h")  # FREQUENT rows at most
    known, held = top["h"].to_numpy(np.int64), np.stack(top["v"]).astype(float) if len(top) else np.zeros((0, size))
    blocks = max(1, -(-vectors.count() // BLOCK))

    def sums(v: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
        made = np.stack([np.bincount(row, v[:, k], rows) for k in range(size)], 1).astype(float)  # of no rows it is an integer
        return pa.ListArray.from_arrays(np.arange(0, made.size + 1, size, dtype=np.int32), made.ravel())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, code, row in (s for batch in batches for s in _slices(batch)):
            at = np.minimum(np.searchsorted(known, names), max(0, len(known) - 1))
            here = (known[at] == names if len(known) else np.zeros(len(names), bool))[code]
            at, h = at[code], names[code]
            m = np.bincount(row, minlength=batch.num_rows)
            none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, -1), pa.int32()), batch.column("p"), batch.column("q"), none, sums(held[at[here]], row[here], batch.num_rows), pa.array(m)], names=["b", "p", "q", "l", "s", "m"])
            h, row = h[~here], row[~here]
            b = (h.view(np.uint64) >> np.uint64(11)).astype(np.int64) % blocks
            order = np.lexsort((b, row))
            h, row, b = h[order], row[order], b[order]
            cut = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
            lists = pa.ListArray.from_arrays(np.append(cut, len(h)).astype(np.int32), h)
            own = pa.array(row[cut])
            yield pa.RecordBatch.from_arrays([pa.array(b[cut], pa.int32()), batch.column("p").take(own), batch.column("q").take(own), lists, pa.nulls(len(cut), pa.list_(pa.float64())), pa.nulls(len(cut), pa.int64())], names=["b", "p", "q", "l", "s", "m"])

    def add(some: pa.Table, words: pa.Table) -> pa.Table:
        some = some.combine_chunks()
        if words.num_rows:
            words = words.sort_by("h").combine_chunks()
            names, v = words["h"].to_numpy(), pc.list_flatten(words["v"]).to_numpy().reshape(-1, size)
        made = []
        for a in range(0, some.num_rows if words.num_rows else 0, 10000):
            part = some.slice(a, 10000).combine_chunks()
            lists = part["l"].combine_chunks() if isinstance(part["l"], pa.ChunkedArray) else part["l"]
            h, row = pc.list_flatten(lists).to_numpy(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(names, h), len(names) - 1)
            here = names[at] == h
            made.append(pa.table({"p": part["p"], "q": part["q"], "s": sums(v[at[here]].astype(float), row[here], part.num_rows)}))
        return pa.concat_tables(made) if made else pa.table({"p": pa.array([], pa.int64()), "q": pa.array([], pa.int64()), "s": pa.array([], pa.list_(pa.float64()))})

    def hashes(c: str) -> list:
        return [F.xxhash64(c, F.lit(k)).alias(name) for k, name in ((1, "p"), (2, "q"))]

    kept = df.select(F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("t")).where("size(t) > 0").select("t", *hashes("t"))
    with _small_batches(df.sparkSession):
        dealt = materialize(kept.mapInArrow(deal, "b int, p long, q long, l array<long>, s array<double>, m long"), "dealt")
    rare = dealt.where("b >= 0").select("b", "p", "q", "l")
    parts = max(1, -(-dealt.sparkSession.sparkContext.defaultParallelism // blocks), -(-(rare.agg(F.sum(F.size("l"))).first()[0] or 0) // (PART * blocks)))
    part = lambda *c: F.pmod(F.xxhash64(*c), F.lit(parts)).cast("int").alias("part")
    of = F.pmod(F.shiftrightunsigned("h", 11), F.lit(blocks)).cast("int").alias("b")
    words = vectors.select(of, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "h", "v")
    met = rare.select("b", part("p", "q"), "p", "q", "l").groupBy("b", "part").cogroup(words.groupBy("b", "part")).applyInArrow(add, "p long, q long, s array<double>")
    both = dealt.where("b < 0").select("p", "q", "s", "m").unionByName(met, allowMissingColumns=True)
    mean = both.groupBy("p", "q").agg(F.sum("m").alias("m"), *[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(size)])
    mean = materialize(mean.select("p", "q", F.array(*[F.col(f"s{k}") / F.col("m") for k in range(size)]).alias("_mean")), "means")
    discard(dealt)
    key = [F.xxhash64(F.col(tokens), F.lit(k)) for k in (1, 2)]
    zero = F.array(*[F.lit(0.0)] * size)
    out = df.withColumns({"_p": key[0], "_q": key[1]}).join(mean.withColumnsRenamed({"p": "_p", "q": "_q"}), ["_p", "_q"], "left")
    return out.select(*df.columns, array_to_vector(F.coalesce("_mean", zero)).alias(target))
