"""Quality classifier: naive Bayes support vectors.

A text is the set of its character trigrams (of UTF-8 bytes, case kept, hashed to ``2^BITS`` features) and of patterns of
its word bigrams: whether at least so large a share of them is one word twice, and how many words there are. An indicator is
scaled by the log ratio of its smoothed class counts, the scaled vector to unit length, and a linear hinge-loss model is
fitted by dual coordinate descent. Margins become scores by a logistic curve fitted on labelled rows that the
coordinate descent did not see.

The model is fitted on at most ``sample_rows`` labelled rows, those of the smallest hash of the id, in one task; each of
them is read whole. Scoring reads every text once, in the order stored, and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm import tokens as T

BITS = 18
SAMPLE_ROWS = 12_000


def trigrams(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text: all in a row, and where each text's begin. A text's first two bytes make
    features with the places before it, so every text but the empty one has some."""
    x = data.astype(np.uint32)
    one, two = np.zeros_like(x), np.zeros_like(x)
    one[1:], two[2:] = x[:-1] + np.uint32(1), x[:-2] + np.uint32(1)
    starts = offsets[:-1][np.diff(offsets) > 0]
    one[starts] = 0
    two[starts] = 0
    two[(starts + 1)[starts + 1 < len(x)]] = 0
    code = ((x + np.uint32(1)) + one * np.uint32(257) + two * np.uint32(66049)) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    key = np.sort((doc << bits) | code)
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(key >> bits, np.arange(len(offsets)))


#: Shares of word bigrams that are one word twice; each is a feature if the text has at least that share.
TWICE = np.array([0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.13, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8])
PATTERNS = len(TWICE) + 20


def features_of(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams and bigram patterns of each text, as ``trigrams`` gives them; patterns come after the trigrams."""
    flat, bounds = trigrams(data, offsets, bits)
    words = T.space_words(data, offsets)
    h, off = words.hashes(), words.offsets
    n = np.diff(off)
    same = np.zeros(len(h) + 1, np.int64)
    same[1:-1] = h[1:] == h[:-1] if len(h) else 0
    same[off] = 0
    total = np.concatenate(([0], np.cumsum(same)))
    share = (total[off[1:]] - total[off[:-1]]) / np.maximum(n - 1, 1)
    passed = (TWICE[None, :] <= share[:, None]).sum(axis=1)
    band = np.minimum(np.ceil(np.log2(n + 1)), 19).astype(np.int64)
    parts, size = [], 1 << bits
    for i in range(len(n)):
        parts += [flat[bounds[i] : bounds[i + 1]], np.arange(size, size + passed[i]), [size + len(TWICE) + band[i]]]
    counts = np.diff(bounds) + passed + 1
    every = np.concatenate(parts).astype(np.int32) if parts else flat
    return every, np.concatenate(([0], np.cumsum(counts)))


def log_count_ratios(features: list[np.ndarray], y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    """log of p / q per feature, p and q the smoothed shares of the classes' counts."""
    counts = [alpha + np.bincount(np.concatenate([f for f, k in zip(features, y) if k == c] or [np.zeros(0, np.int32)]), minlength=size) for c in (1, 0)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 20, seed: int = 1) -> np.ndarray:
    """Weights of ``min |w|^2 / 2 + sum cost_i * max(0, 1 - y_i w.x_i)`` (y is -1 or 1; the last weight is the bias,
    whose feature is 1 everywhere)."""
    w, alpha, rng = np.zeros(size + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    q = np.array([v @ v + 1.0 for _, v in rows])
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + w[size]) - 1.0
            if (alpha[i] == 0 and g >= 0) or (alpha[i] == cost[i] and g <= 0):
                continue
            most = max(most, abs(g))
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[at] += step * v
            w[size] += step
        if most < 1e-3:
            break
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a, b of the smoothed maximum-likelihood curve ``1 / (1 + exp(-(a * margin + b)))``."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    p = np.array([1.0, np.log((pos + 1) / (neg + 1))])
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        grad = x.T @ (s - t) + 1e-4 * p
        hess = (x * (s * (1 - s))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        p -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(p[0], 1e-3)), float(p[1])


def fit_nbsvm(features: list[np.ndarray], y: np.ndarray, bits: int = BITS, cost: float = 1.0) -> dict[str, np.ndarray]:
    """Model from feature sets and 0/1 labels: per feature ``ratio`` and ``weight``, and ``curve`` (a, b, bias).

    Without rows of both classes, scores are the share of class 1 (one half without rows).
    """
    size = (1 << bits) + PATTERNS
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return {"ratio": np.zeros(size), "weight": np.zeros(size), "curve": np.array([1e-3, np.log(share / (1 - share)), 0.0])}
    apart = np.arange(len(y)) % 5 == 0
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart = np.ones(len(y), bool)
        learn = apart
    else:
        learn = ~apart
    ratio = log_count_ratios([f for f, k in zip(features, learn) if k], y[learn], size)
    rows = [(f, _unit(ratio[f])) for f in features]
    sign = np.where(y == 1, 1.0, -1.0)
    balance = np.where(y == 1, 0.5 / max(1, (y[learn] == 1).sum()), 0.5 / max(1, (y[learn] == 0).sum())) * learn.sum() * cost
    w = dual_coordinate_descent([r for r, k in zip(rows, learn) if k], sign[learn], size, balance[learn])
    margin = np.array([w[at] @ v + w[size] for (at, v), k in zip(rows, apart) if k])
    a, b = logistic_curve(margin, sign[apart])
    return {"ratio": ratio, "weight": w[:size] * ratio, "curve": np.array([a, b, w[size]])}


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt(v @ v)
    return v / n if n else v


def scores(model: dict[str, np.ndarray], features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = lambda v: np.add.reduceat(np.append(v[features], 0.0), np.minimum(offsets[:-1], len(features))) * (np.diff(offsets) > 0)
    norm = np.sqrt(sums(model["square"] if "square" in model else model["ratio"] ** 2))
    a, b, bias = model["curve"]
    margin = sums(model["weight"]) / np.where(norm > 0, norm, 1) + bias
    return 1 / (1 + np.exp(-(a * margin + b)))


def bounded_sample(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """``(id, y, text)`` for the ``rows`` ids of ``chosen`` (id, y) with the smallest hash, one text each (the least of
    several). Only the ids are broadcast, and their number is bounded by ``rows``."""
    ids = chosen.where("id is not null").orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(T.column(id_col).alias("id"), F.coalesce(T.column(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text"))


def fold(id_col: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, learn: F.Column | None = None, sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Model from the labelled rows for whose id ``learn`` holds. Labels other than 0 and 1 and ids whose labels
    contradict each other are left out."""
    y = labels.select(T.column(id_col).alias(id_col), T.column(label_col).cast("int").alias("y")).where("y in (0, 1)")
    y = (y if learn is None else y.where(learn)).groupBy(T.column(id_col).alias("id")).agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    sample = bounded_sample(docs, y, id_col, text_col, sample_rows)

    T.bound_batches(docs.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = T.filled(batch.column(2))
            for a, b in T.slices(text):
                flat, off = features_of(*T.utf8(text.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.string()), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat))], names=["id", "y", "features"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _arrays(b.column(2)))), key=lambda row: row[0])
        model = fit_nbsvm([f for _, _, f in rows], np.array([y for _, y, _ in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model[k].astype("<f8").tobytes()], pa.binary()) for k in _PARTS], names=_PARTS)

    made = sample.mapInArrow(sets, "id string, y int, features array<int>").repartition(1).mapInArrow(fit, ", ".join(f"{k} binary" for k in _PARTS)).first()
    model = {k: np.frombuffer(bytes(made[k]), "<f8") for k in _PARTS}
    return model | {"square": model["ratio"] ** 2}


_PARTS = ["ratio", "weight", "curve"]


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    off, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in zip(off, off[1:])]


def score_quality(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``doc`` (struct of the columns of ``docs``) and ``score``: 0 to 1, higher where label 1 is likelier.

    Null texts count as empty; empty texts are scored by the model's bias and their length alone. Repeated rows are scored
    each; an empty table gives no rows; columns keep their names inside ``doc``, whatever they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    T.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = T.filled(batch.column(1))
            for a, b in T.slices(text):
                s = scores(shared.value, *features_of(*T.utf8(text.slice(a, b - a))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s)], names=["doc", "score"])

    packed = T.row_and_text(docs, text_col)
    return packed.mapInArrow(run, T.schema(packed, "doc", "score double"))


def op4_nbsvm_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from four fifths of the labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit_quality(docs, labels, learn=fold("doc_id", 5) != 0)
    held = F.coalesce(fold("doc.doc_id", 5) == 0, F.lit(False))
    return score_quality(docs, model).select(F.col("doc.doc_id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
