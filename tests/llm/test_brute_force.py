"""Parts of the training-data operators against plain scalar versions."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import fm_index, langid, licenses, media, packing, quality, queries, sharding, tokens


def test_ratios_and_dual_optimum():
    rng = np.random.default_rng(0)
    size, n = 12, 40
    features = [np.unique(rng.integers(0, size, 5)) for _ in range(n)]
    y = np.array([int(f.sum() + rng.integers(0, 9) > 25) for f in features])
    ratio = quality.log_count_ratios(features, y, size)
    counts = [[1 + sum(k in f for f, c in zip(features, y) if c == label) for k in range(size)] for label in (1, 0)]
    want = [math.log(counts[0][k] / sum(counts[0])) - math.log(counts[1][k] / sum(counts[1])) for k in range(size)]
    assert np.allclose(ratio, want)
    rows = [(f, ratio[f] / np.linalg.norm(ratio[f])) for f in features]
    sign, cost = np.where(y == 1, 1.0, -1.0), np.full(n, 0.7)
    w = quality.dual_coordinate_descent(rows, sign, size, cost, epochs=500)
    primal = lambda v: v @ v / 2 + sum(c * max(0.0, 1 - s * (v[f] @ x + v[size])) for (f, x), s, c in zip(rows, sign, cost))
    least = primal(w)
    assert all(least <= primal(w + d) + 1e-3 for d in rng.normal(0, 0.05, (300, size + 1)))


def test_votes():
    rng = np.random.default_rng(1)
    names = ["a", "b,c", "d"]
    model = {"contests": [("f", "a", "b,c"), ("f", "a", "d"), ("f", "b,c", "d")]}
    margin = rng.normal(0, 1, (50, 3))
    best, prob = langid._winner(names, "f", model, margin, 1 / (1 + np.exp(-margin)))
    for m, b, p in zip(margin, best, prob):
        votes, sums, least = [0] * 3, [0.0] * 3, [1.0] * 3
        for k, (i, j) in enumerate([(0, 1), (0, 2), (1, 2)]):
            votes[i if m[k] >= 0 else j] += 1
            sums[i], sums[j] = sums[i] + m[k], sums[j] - m[k]
            q = 1 / (1 + math.exp(-m[k]))
            least[i], least[j] = min(least[i], q), min(least[j], 1 - q)
        assert votes[b] == max(votes) and sums[b] == max(s for s, v in zip(sums, votes) if v == max(votes)) and math.isclose(p, least[b])


def test_languages_of_any_name(spark):
    rows = [(i, ("der hund und die katze %d" if i % 2 else "the dog and the cat %d") % i, "pt,br" if i % 2 else "x y", i) for i in range(60)] + [(60, None, None, 1), (61, "", "pt,br", 1), (61, "", "pt,br", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` int")
    got = langid.identify(df, langid.fit_languages(df)).collect()
    assert all(r.lang_pred == (r.doc.lang if r.doc.text else "und") for r in got) and len(got) == 63


def scalar_feistel(i, n, seed):
    half = sharding._half_bits(n)
    while True:
        a, b = i >> half, i & ((1 << half) - 1)
        for key in sharding._keys(seed):
            x = (b + key) * 0x9E3779B97F4A7C15 % 2**64
            x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % 2**64
            a, b = b, a ^ ((x ^ (x >> 32)) & ((1 << half) - 1))
        i = (a << half) | b
        if i < n:
            return i


def test_shards_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op8_feistel_shards"](spark, sf).collect()}
    assert len(got) == len(docs)
    for k, d in enumerate(sorted(docs, key=lambda d: d.doc_id)):
        place, raw = scalar_feistel(k, len(docs), 8), (d.text or "").encode()
        r = got[d.doc_id]
        assert (r.shard, r.slot, r.size, r.text_crc32, r.law, r.grown_shard) == (place % 40, place // 40, len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_media_of_documents(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op9_media_columns"](spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts)
    stored = {}
    for r in got:
        raw = texts[r.doc_id].encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        held = media.store(p)
        assert (r.media_bytes, r.media_sha256) == (len(held), hashlib.sha256(held).hexdigest())
        assert stored.setdefault(texts[r.doc_id], r.feature) == r.feature


def track(number, handler, codec, tables):
    tkhd = media._full(b"tkhd", struct.pack(">III", 0, 0, number), bytes(68))
    mdhd = media._full(b"mdhd", struct.pack(">IIII", 0, 0, 10, 0), bytes(4))
    stsd = media._full(b"stsd", struct.pack(">I", 1), media._box(codec, bytes(16)))
    return media._box(b"trak", tkhd, media._box(b"mdia", mdhd, media._full(b"hdlr", bytes(4), handler, bytes(12)), media._box(b"minf", media._box(b"stbl", stsd, *tables))))


def test_fragments_and_tracks():
    full = media._full
    audio = track(1, b"soun", b"mp4a", [full(b"stsz", struct.pack(">II", 0, 0)), full(b"stco", struct.pack(">I", 0))])
    video = track(2, b"vide", b"avc1", [])
    mvex = media._box(b"mvex", full(b"trex", struct.pack(">5I", 2, 1, 5, 4, 0x10000)))
    moov = media._box(b"moov", audio, video, mvex)

    def moof(at):
        trun = full(b"trun", struct.pack(">IiI", 3, at, 0), struct.pack(">3I", 6, 4, 2), flags=0x205)
        return media._box(b"moof", media._box(b"traf", full(b"tfhd", struct.pack(">I", 2), flags=0x20000), trun))

    body = moov + moof(len(moof(0)) + 8) + media._box(b"mdat", b"KEYSIXabcdZZ")
    said = media.describe(body)
    assert said["codec"] == "avc1" and [t["codec"] for t in said["tracks"]] == ["mp4a", "avc1"] and said["n_samples"] == 3 and said["duration"] == 1.5
    (key,) = said["keyframes"]
    assert body[key["start"] : key["end"]] == b"KEYSIX" and said["payload_sha256"] == hashlib.sha256(b"KEYSIXabcdZZ").hexdigest()


def test_hostile_containers():
    full = media._full
    deep = b""
    for _ in range(3000):
        deep = media._box(b"moov", deep)
    assert media.tracks(deep) == []
    tables = [full(b"stsz", struct.pack(">II", 0, 4000000000)), full(b"stsc", struct.pack(">I", 1), struct.pack(">III", 1, 4000000000, 1)), full(b"stco", struct.pack(">I", 4), struct.pack(">4I", 0, 1, 2, 3))]
    assert media.describe(media._box(b"moov", track(1, b"vide", b"avc1", tables)))["payload_bytes"] == 0
    tables[0] = full(b"stsz", struct.pack(">II", 9, 4000000000))
    assert media.describe(media._box(b"moov", track(1, b"vide", b"avc1", tables)))["payload_bytes"] <= 600
    trun = full(b"trun", struct.pack(">I", 4000000000))
    traf = media._box(b"traf", full(b"tfhd", struct.pack(">II", 1, 1), flags=0x10), trun)
    bomb = media._box(b"moov", track(1, b"vide", b"avc1", [])) + media._box(b"moof", *[traf] * 300)
    assert media.describe(bomb)["payload_bytes"] <= len(bomb)
    rng = np.random.default_rng(5)
    whole = np.frombuffer(media.store(bytes(range(200)), chunk=64), np.uint8)
    for _ in range(400):
        broken = whole.copy()
        broken[rng.integers(0, len(broken), 3)] = rng.integers(0, 256, 3)
        assert media.describe(broken.tobytes())["payload_bytes"] <= len(broken)


@pytest.mark.parametrize("name", ["a.b", "`q`", "text"])
def test_columns_of_any_name(spark, name):
    df = spark.createDataFrame([(1, "the mit license", "x"), (2, None, "y")], ["doc_id", "te.xt", name])
    for got in (licenses.scan_licenses(df, "te.xt"), media.probe(media.store_texts(df, "te.xt")).select("row.doc"), fm_index.find_leaks(df, df.select(F.col("doc_id").alias("item_id"), F.col("`te.xt`").alias("text")), "te.xt")):
        assert got.schema["doc"].dataType.names == df.columns and got.count() == 2
    assert packing.pack_documents(df, packing.public_vocabulary(), text_col="te.xt").count() == 2
    clean = fm_index.remove_leaks(df, spark.createDataFrame([(1, "mit license")], "item_id int, text string"), "te.xt")
    assert clean.columns == df.columns and {r["te.xt"] for r in clean.collect()} == {"the \n", None}


def test_phrases_of_a_block():
    texts = ["a b c d", "x", "", None, "b c d", "a b c d"]
    p = fm_index.Phrases([1, 2, 3, 4, 5, 6], texts, 3)
    word = {h: i + fm_index.FIRST_WORD for i, h in enumerate(p.vocabulary.tolist())}
    code = lambda t: word[int(tokens.hash_spans(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t)]))[0])]
    want = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        for k in range(max(len(w) - 3, 0) + 1 if w else 0):
            want.setdefault(tuple(map(code, w[k : k + 3])), set()).add(i)
    got = {tuple(r[r > 0].tolist()): set(p.items[a:b].tolist()) for r, a, b in zip(p.rows, p.item_offsets, p.item_offsets[1:])}
    assert got == want
