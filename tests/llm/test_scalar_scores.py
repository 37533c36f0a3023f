"""Scores of the quality and language queries, recomputed text by text from the fitted model in plain Python."""

import math
import re
import zlib

import pytest

from quayside.llm import langid, quality, queries


def trigrams(text: str, bits: int) -> set[int]:
    """Each byte with the two before it, hashed; places before the text count as zero."""
    raw, out = text.encode(), set()
    for i, x in enumerate(raw):
        one = raw[i - 1] + 1 if i > 0 else 0
        two = raw[i - 2] + 1 if i > 1 else 0
        code = x + 1 + one * 257 + two * 257 * 257
        out.add(code * 0x9E3779B1 % 2**32 >> (32 - bits))
    return out


def quality_features(text: str) -> set[int]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    twice = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1)
    size = 1 << quality.BITS
    out = trigrams(text, quality.BITS)
    out |= {size + k for k, least in enumerate(quality.TWICE) if twice >= least}
    band = 0
    while 2**band < len(words) + 1:
        band += 1
    return out | {size + len(quality.TWICE) + min(band, 19)}


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x))


def quality_score(model: dict, text: str) -> float:
    found = quality_features(text)
    norm = math.sqrt(math.fsum(float(model["ratio"][k]) ** 2 for k in found)) or 1.0
    a, b, bias = model["curve"]
    return logistic(a * (math.fsum(float(model["weight"][k]) for k in found) / norm + bias) + b)


def winner(names: list[str], place: str, contests: dict, margins: dict) -> tuple[str, float]:
    votes, sums, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
    for (where, one, other), (a, b, _) in contests.items():
        if where != place:
            continue
        m = margins[where, one, other]
        votes[one if m >= 0 else other] += 1
        sums[one], sums[other] = sums[one] + m, sums[other] - m
        p = logistic(a * m + b)
        least[one], least[other] = min(least[one], p), min(least[other], 1 - p)
    best = max(names, key=lambda x: (votes[x], sums[x]))
    return best, least[best]


def language(model: dict, text: str) -> tuple[str, float]:
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    found = sorted(trigrams(lowered, langid.BITS))
    contests = dict(zip(model["contests"], model["curves"]))
    margins = {c: math.fsum(model["weight"][found, k].tolist()) / math.sqrt(len(found)) + curve[2] for k, (c, curve) in enumerate(contests.items())}
    family, p = winner(sorted(set(model["families"].values())), "", contests, margins)
    lang, q = winner([x for x in model["langs"] if model["families"][x] == family], family, contests, margins)
    return lang, p * q


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")


HARD = ["", " ", "a", "É", "\x00", "é a É a", "go go go go", "A a A b", "x" * 30_000, "the the cat\tsat\x0bon a mat " * 300]


def test_every_quality_score(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    model = quality.fit_quality(documents, labels, learn=quality.fold("doc_id", 5) != 0)
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    got = queries.QUERIES["op4_nbsvm_quality"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        want = quality_score(model, texts[r.doc_id])
        assert math.isclose(r.score, want, rel_tol=1e-9, abs_tol=1e-12)
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    hard = quality.score_quality(spark.createDataFrame(list(enumerate(HARD)), "i int, text string"), model).collect()
    assert [HARD[r.doc.i] for r in hard if not math.isclose(r.score, quality_score(model, HARD[r.doc.i]), rel_tol=1e-9)] == []


def test_quality_model_ignores_held_out_labels(spark, sf, documents):
    """Other labels of the held-out rows change no score."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    learn = quality.fold("doc_id", 5) != 0
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    one, other = (quality.fit_quality(documents, x, learn=learn) for x in (labels, turned))
    assert all((one[k] == other[k]).all() for k in ("ratio", "weight", "curve"))


def test_every_language(spark, sf, documents):
    model = langid.fit_languages(documents, learn=quality.fold("doc_id", 4) != 2)
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    got = queries.QUERIES["op7_language_families"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        lang, score = language(model, texts[r.doc_id])
        assert r.lang_pred == lang and math.isclose(r.score, score, rel_tol=1e-6, abs_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    hard = langid.identify(spark.createDataFrame(list(enumerate(HARD)), "i int, text string"), model).collect()
    for r in hard:
        lang, score = language(model, HARD[r.doc.i])
        assert r.lang_pred == lang and math.isclose(r.score, score, rel_tol=1e-6, abs_tol=1e-9)
