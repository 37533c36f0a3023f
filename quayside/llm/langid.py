"""Language identification in two steps: the family, then the language within it.

A text is the set of its byte trigrams (A-Z lower-cased) at unit length. Families are told apart, and then the languages
of the family that was predicted, by linear support vector machines for each two of them; most votes win, equal votes go
by the sum of margins. A pair's margin becomes a probability by a logistic curve; the score of a text is that of the
family's and of the language's closest contest, multiplied.

Which languages are close is a parameter. A language that no family names makes a family of its own. The machines are
fitted on at most ``sample_rows`` rows, those of the smallest hash of the id, one model a task; scoring reads every text
once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm import tokens as T
from quayside.llm.quality import _arrays, bounded_sample, dual_coordinate_descent, fold, logistic_curve, trigrams

BITS = 17
SAMPLE_ROWS = 8_000
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
}


def _lower(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def _family_of(lang: str, families: dict[str, list[str]]) -> str:
    return next((f for f, members in families.items() if lang in members), lang)


def contests(langs: list[str], families: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    """(where, one, other): ``where`` is "" between families, else the family."""
    groups: dict[str, list[str]] = {}
    for lang in sorted(langs):
        groups.setdefault(_family_of(lang, families), []).append(lang)
    return [("", a, b) for a, b in combinations(sorted(groups), 2)] + [(f, a, b) for f in sorted(groups) for a, b in combinations(groups[f], 2)]


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, learn: F.Column | None = None, families: dict[str, list[str]] | None = None, sample_rows: int = SAMPLE_ROWS, cost: float = 4.0) -> dict:
    """Machines for all contests among the languages of the rows with a language and an id for which ``learn`` holds."""
    families = FAMILIES if families is None else families
    known = docs.select(T.column(id_col).alias(id_col), T.column(lang_col).cast("string").alias("y")).where("y is not null")
    known = (known if learn is None else known.where(learn)).groupBy(T.column(id_col).alias("id")).agg(F.min("y").alias("y"))
    sample = bounded_sample(docs, known, id_col, text_col, sample_rows).where("text <> ''")

    T.bound_batches(docs.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = T.filled(batch.column(2))
            for a, b in T.slices(text):
                data, off = T.utf8(text.slice(a, b - a))
                flat, bounds = trigrams(_lower(data), off, BITS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.string()), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))], names=["id", "y", "features"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _arrays(b.column(2)))), key=lambda row: row[0])
        langs = sorted({y for _, y, _ in rows})
        held = np.bincount(np.concatenate([np.zeros(0, np.int64), *(f for _, _, f in rows)]), minlength=1 << BITS)
        shared = [(y, np.mean(held[f] > 1)) for _, y, f in rows if len(f)]
        usual = np.array([np.median([v for z, v in shared if z == y] or [0.0]) for y in langs])
        yield _weights("languages", "", "", (held > 1).astype(float), usual, langs)
        for where, one, other in contests(langs, families):
            side = lambda y: y if where else _family_of(y, families)  # noqa: E731, B023
            mine = [(f, side(y)) for _, y, f in rows if (not where or _family_of(y, families) == where) and side(y) in (one, other)]
            sign = np.array([1.0 if s == one else -1.0 for _, s in mine])
            vectors = [(f, np.full(len(f), 1 / np.sqrt(len(f)))) for f, _ in mine]
            apart = np.arange(len(mine)) % 5 == 0 if len(mine) >= 50 else np.ones(len(mine), bool)
            learn_ = ~apart if len(mine) >= 50 else apart
            if len(set(sign[learn_])) < 2:
                learn_ = np.ones(len(mine), bool)
            share = np.where(sign > 0, 0.5 / max(1, (sign[learn_] > 0).sum()), 0.5 / max(1, (sign[learn_] < 0).sum())) * learn_.sum() * cost
            w = dual_coordinate_descent([v for v, k in zip(vectors, learn_) if k], sign[learn_], 1 << BITS, share[learn_])
            margin = np.array([w[at] @ v + w[1 << BITS] for (at, v), k in zip(vectors, apart) if k])
            a, b = logistic_curve(margin, sign[apart])
            yield _weights(where, one, other, w[: 1 << BITS], np.array([a, b, w[1 << BITS]]))

    made = sample.mapInArrow(sets, "id string, y string, features array<int>").repartition(1).mapInArrow(fit, _MACHINE).collect()  # a row a contest
    langs = [x for r in made if r.langs is not None for x in r.langs]
    pairs = [r for r in made if r.langs is None]
    weight = np.zeros((1 << BITS, max(1, len(pairs))), np.float32)
    for k, r in enumerate(pairs):
        weight[np.frombuffer(bytes(r["at"]), "<i4"), k] = np.frombuffer(bytes(r.weight), "<f8")
    seen, usual = np.zeros(1 << BITS, bool), {}
    for r in made:
        if r.langs is not None:
            seen[np.frombuffer(bytes(r["at"]), "<i4")] = True
            usual = dict(zip(langs, r.curve))
    return {"seen": seen, "usual": usual, "langs": langs, "families": {x: _family_of(x, families) for x in langs}, "contests": [(r.place, r.one, r.other) for r in pairs], "weight": weight, "curves": np.array([r.curve for r in pairs]).reshape(-1, 3)}


_MACHINE = "place string, one string, other string, at binary, weight binary, curve array<double>, langs array<string>"


def _weights(where: str, one: str, other: str, w: np.ndarray, curve: np.ndarray, langs: list[str] | None = None) -> pa.RecordBatch:
    some = np.flatnonzero(w)
    at, weight = pa.array([some.astype("<i4").tobytes()], pa.binary()), pa.array([w[some].astype("<f8").tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([where]), pa.array([one]), pa.array([other]), at, weight, T.list_column([curve], pa.float64()), pa.array([langs], pa.list_(pa.string()))], names=[x.split()[0] for x in _MACHINE.split(", ")])


def _winner(names: list[str], place: str, model: dict, margin: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the name with most votes for each row, and the probability of its closest contest."""
    n = len(margin)
    votes, sums, least = np.zeros((n, len(names))), np.zeros((n, len(names))), np.ones((n, len(names)))
    for k, (where, one, other) in enumerate(model["contests"]):
        if where == place and one in names:
            i, j = names.index(one), names.index(other)
            votes[:, i] += margin[:, k] >= 0
            votes[:, j] += margin[:, k] < 0
            sums[:, i] += margin[:, k]
            sums[:, j] -= margin[:, k]
            least[:, i] = np.minimum(least[:, i], prob[:, k])
            least[:, j] = np.minimum(least[:, j], 1 - prob[:, k])
    best = np.argmax(votes + 0.49 * np.tanh(sums), axis=1)
    return best, least[np.arange(n), best]


def predict(model: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and ``known`` (see ``identify``) of each text, texts without letters included (the caller tells
    those apart)."""
    flat, bounds = trigrams(_lower(data), offsets, BITS)
    n = np.diff(bounds)
    rows = np.concatenate((model["weight"][flat], np.zeros((1, model["weight"].shape[1]), np.float32)))
    sums = np.add.reduceat(rows, np.minimum(bounds[:-1], len(flat)), axis=0, dtype=np.float64) * (n > 0)[:, None]
    curves = model["curves"]
    seen = np.add.reduceat(np.append(model["seen"][flat], False), np.minimum(bounds[:-1], len(flat)), dtype=np.float64) * (n > 0)
    margin = sums[:, : len(curves)] / np.sqrt(np.maximum(n, 1))[:, None] + curves[:, 2]
    prob = 1 / (1 + np.exp(-np.clip(curves[:, 0] * margin + curves[:, 1], -40, 40)))
    families = sorted(set(model["families"].values()))
    fam, p = _winner(families, "", model, margin, prob)
    lang, score = np.full(len(n), "und", object), np.zeros(len(n))
    for i, f in enumerate(families):
        mine = np.flatnonzero(fam == i)
        names = [x for x in model["langs"] if model["families"][x] == f]
        best, q = _winner(names, f, model, margin[mine], prob[mine])
        lang[mine] = np.array(names, object)[best]
        score[mine] = p[mine] * q
    usual = n * np.array([model["usual"][x] for x in lang])
    known = np.where(usual > 0, np.minimum(1.0, seen / np.where(usual > 0, usual, 1.0)), 1.0)
    return lang, score, known


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a letter: ASCII ones by an array step, the others by their characters."""
    low = _lower(data)
    seen = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = T.has_letter(data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return out


def identify(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``doc`` (struct of the columns of ``docs``), ``lang_pred``, ``score`` and ``known``.

    The score says which language is likelier, not whether the text is in any of them: where no trigram is known, it is what
    the machines' constants make of it. ``known`` tells that: the share of the text's trigrams that two learned rows have (so
    a row does not vouch for itself), over the median of that share among the learned rows of ``lang_pred``, at most 1. It is
    1 where nothing can be said: no language was learned, or no row to compare with, or the text has no trigram.

    Null or empty texts and texts without a letter are ``und`` with score and known 0. If nothing was learned, everything is
    ``und`` with score 0. Repeated rows are reported each; an empty table gives no rows; columns keep their names inside
    ``doc``, whatever they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    T.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            text = T.filled(batch.column(1))
            for a, b in T.slices(text):
                data, off = T.utf8(text.slice(a, b - a))
                told = _letters(data, off)
                lang, score, known = predict(m, data, off) if m["langs"] else (np.full(b - a, "und", object), np.zeros(b - a), np.ones(b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.where(told, lang, "und").tolist(), pa.string()), pa.array(np.where(told, score, 0.0)), pa.array(np.where(told, known, 0.0))], names=["doc", "lang_pred", "score", "known"])

    packed = T.row_and_text(docs, text_col)
    return packed.mapInArrow(run, T.schema(packed, "doc", "lang_pred string, score double, known double"))


def op7_language_families(spark, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from three quarters of the ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_languages(docs, learn=fold("doc_id", 4) != 2)
    held = F.coalesce(fold("doc.doc_id", 4) == 2, F.lit(False))
    return identify(docs.select("doc_id", "text"), model).select(F.col("doc.doc_id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score")
