"""The training-data operators against brute force, on edge cases and on the given tables."""

import base64
import hashlib
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import duck, rows
from quayside.llm import fm_index, jaccard_join, langid, licenses, media, packing, quality, queries, sharding, tokens, tool_calls, warc

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 30_000
#: Nulls, empty and very long texts, repeated rows, and columns that clash with names used inside.
EDGE = [(1, None, "a", 1), (2, "", "b", 2), (3, " \n\t", "c", 3), (4, "One", "d", 4), (4, "One", "d", 4), (5, LONG, "e", 5), (None, "x y z w v", "f", 6), (7, "x y z w v", "g", 7), (8, "é 日本語 😀 \x00 b", "h", None)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, doc string, size long")


@pytest.fixture(scope="module")
def none(edge):
    return edge.where("doc_id < 0")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(duck(sf).execute(queries.SQL[name]).df())


# -- words and shingles

TEXTS = st.lists(st.text(st.sampled_from("abAB Z09é日😀\n\t\x00.,-_'"), max_size=40), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    col = tokens.filled(pa.array(texts, pa.string()))
    for make, pattern in ((tokens.alnum_words, ALNUM), (tokens.space_words, SPACED)):
        w = make(*tokens.utf8(col))
        got = [[w.low[w.starts[i] : w.ends[i]].tobytes().decode() for i in range(a, b)] for a, b in zip(w.offsets, w.offsets[1:])]
        assert got == [pattern.findall(t.translate(LOWER)) for t in texts]
        h = w.hashes()
        flat = [x for g in got for x in g]
        assert len({*zip(flat, h.tolist())}) == len(set(flat)) == len(set(h.tolist()))


# -- 1 licences


def test_license_places(spark, edge, none):
    t = "Under the MIT License, under the mit-license; CC BY-NC 4.0"
    df = edge.select("doc_id", "text").unionByName(spark.createDataFrame([(20, t), (21, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath */")], "doc_id long, text string"))
    got = {r.doc.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert (got[20].n_base, got[20].first_word, got[20].last_word, got[20].base_labels) == (3, 0, 8, ["cc-by-nc", "mit"])
    assert got[21].expressions == ["(Apache-2.0 OR MIT) AND GPL-2.0 WITH Classpath"] and "gpl-2.0" in got[21].labels
    assert got[1].n_words == 0 and got[1].first_word is None and got[5].n_words == 150_000
    assert licenses.scan_licenses(none).count() == 0


def test_license_expressions():
    parse = licenses.parse_expression
    assert parse("mit and mit")[1] == "mit" and parse("A OR B AND C")[1] == "A OR B AND C" and parse("(A or B) and (A or B)")[1].count("A") == 1
    assert parse("AND MIT") is None and parse("(MIT") is None and parse("") is None and parse("MIT or") == (["mit"], "MIT")


def test_license_query_brute_force(spark, sf, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.QUERIES["op1_license_scan"](spark, sf).collect():
        w = ALNUM.findall(texts[r.doc_id].translate(LOWER))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


# -- 2 web archives


def test_arc_headers():
    for v in (1, 2):
        data = warc.arc_version_block(v, "x", "20200101000000") + warc.arc_record(v, b"http://a b/", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\nhi", "x", 0)
        (r,) = warc.parse_arc(data)
        assert r["url"] == "http://a%20b/" and not r["truncated"]
        s = warc.synthesise(r)
        assert s["date"] == "2020-01-02T03:04:05Z" and s["payload"] == b"hi" and s["type"] == "response"
        (cut,) = warc.parse_arc(data[:-4])
        assert cut["truncated"]
    (bad,) = warc.parse_arc(b"http://x 1 2 3 4\n")
    assert bad["problem"] and bad["block"] == b"http://x 1 2 3 4\n"
    good = warc.arc_record(1, b"http://a/", "20200102030405", "text/html; charset=utf-8", b"hi", "x", 0)
    found = list(warc.parse_arc(warc.arc_version_block(1, "x", "2020") + b"only three fields\nand more\n" + good + b"http://a b/ 1.1.1.1 20200102030405 text/html 2\nyo\n"))
    assert [r["problem"] is None for r in found] == [False, True, True] and [r["block"] for r in found] == [b"only three fields\nand more\n", b"hi", b"yo"]
    assert found[1]["type"] == "text/html; charset=utf-8" and found[2]["url"] == "http://a b/"
    assert warc.warc_date("2020") == "2020-01-01T00:00:00Z" and warc.warc_date("junk") == "1970-01-01T00:00:00Z"


def test_pages_and_revisits(spark, tmp_path):
    pages = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c/\n x", None), (4, "http://d/", ""), (5, "http://e/", "é" * 70_000), (6, "http://f/", "same"), (6, "http://f/", "same")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.op2_arc_to_warc(spark, str(tmp_path)).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, "revisit", 6, 4, digest("same")), (2, "revisit", 6, 4, digest("same")), (3, "revisit", 4, 0, digest("")), (4, "response", None, 0, digest("")), (5, "response", None, 140_000, digest("é" * 70_000)), (6, "response", None, 4, digest("same")), (6, "response", None, 4, digest("same"))]
    assert got == want
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/e/pages.parquet")
    assert warc.op2_arc_to_warc(spark, f"{tmp_path}/e").count() == 0


def test_damaged_archives(spark):
    record = lambda i, body: {"record_id": f"urn:{i}", "type": "resource", "uri": "u", "date": "d", "mime": "text/plain", "head": b"", "payload": body, "payload_digest": warc.base32_sha1(body), "truncated": False, "refers_to": None}
    parts = [warc._gzip(warc._warc_record(record(i, b"x%d" % i * 50)), 4) for i in range(4)]
    false = warc._gzip(warc._warc_record(record(9, b"true")).replace(b"true", b"lied"), 4)
    data = parts[0] + parts[1][:-30] + b"junk" + parts[2] + false + parts[3] + warc._gzip(b"no record", 4) + parts[0][:20]
    got = warc.read_archives(spark.createDataFrame([(data, 1), (None, 2), (b"", 3)], "warc binary, record_id int")).collect()
    assert [r.record_id for r in got if r.problem is None] == ["urn:0", "urn:2", "urn:3"]
    assert {"block differs from its digest", "not a WARC record", "member without an end"} <= {r.problem for r in got}
    many = b"".join(warc._gzip(warc._warc_record(record(i, b"y" * 40)), 1) for i in range(20_000))
    assert sum(p is None for _, _, p in warc.parse_warc(many)) == 20_000


def test_pages_table_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    best = {}
    for p in pages:
        best[p.html or ""] = max(best.get(p.html or "", -1), p.page_id)
    want = {}
    for p in pages:
        raw, k = (p.html or "").encode(), best[p.html or ""]
        want[p.page_id] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if k == p.page_id else "revisit", None if k == p.page_id else k)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op2_arc_to_warc(spark, sf).collect()} == want


# -- 3 packing


def check_pieces(got, texts, tokenizer, capacity=1024):
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["id"], []).append(r)
    for k, parts in by_doc.items():
        ids = np.array(tokenizer.encode(texts[k] or "", add_special_tokens=False).ids + [0], "<u4")
        parts.sort(key=lambda r: r["start"])
        assert [r["start"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts[:-1]]).tolist() and sum(r["length"] for r in parts) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in parts)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s[:-1]]).tolist() and sum(n for _, n in s) <= capacity
    return sum(n for s in seqs.values() for _, n in s) / (len(seqs) * capacity)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.public_vocabulary())


def test_packing(spark, sf, docs, tokenizer):
    got = [r.asDict() | {"id": r.doc_id} for r in queries.QUERIES["op3_ffd_packing"](spark, sf).collect()]
    assert check_pieces(got, {r.doc_id: r.text for r in docs.collect()}, tokenizer) > 0.97


def test_packing_edges(spark, edge, none, tokenizer):
    one = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = [r.asDict() for r in packing.pack_documents(one, packing.public_vocabulary(), length=64, with_ids=True).collect()]
    check_pieces(got, {r.doc_id: r.text for r in one.collect()}, tokenizer, 64)
    assert packing.pack_documents(none, packing.public_vocabulary()).count() == 0
    assert packing.pack_documents(edge, packing.public_vocabulary()).where("id = 4").count() == 2
    full = packing.assembled(packing.pack_documents(one, packing.public_vocabulary(), length=64, with_ids=True), capacity=64)
    assert full.where("size(ids) <> 64").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abzAZ '.-_\n\t 019é日½  sdtmrvel"), max_size=60))
def test_pieces_equal_the_tokenizer(tokenizer, text):
    coder = packing._pieces_of(packing.public_vocabulary())
    (got,) = coder.ids(*tokens.utf8(tokens.filled(pa.array([text]))))
    assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_beyond_the_table(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "_KNOWN_MOST", 1000)
    coder = packing.Pieces(packing.public_vocabulary())
    texts = [" ".join(f"w{i}x" for i in range(a, b)) for a, b in ((0, 300), (100, 800), (0, 300), (250, 900))] + ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", ""]
    for t in texts:
        (got,) = coder.ids(*tokens.utf8(tokens.filled(pa.array([t]))))
        assert got.tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    got = coder.ids(*tokens.utf8(tokens.filled(pa.array(texts))))
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, np.int64), 50)
    free, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = next((k for k, f in enumerate(free) if f >= lengths[i]), None)
        if k is None:
            k = len(free)
            free.append(50)
        want[i] = (k, 50 - free[k])
        free[k] -= lengths[i]
    assert all((bins[i], offsets[i]) == want[i] for i in want)


# -- 4 quality, 7 language


def test_quality_held_out(spark, sf):
    big = sf.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.QUERIES["op4_nbsvm_quality"](spark, big).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    held = [(got[k].predicted, y) for k, y in labels.items() if got[k].held_out]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got) and len(got) == 1000
    assert np.mean([p == y for p, y in held]) >= 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_quality_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (4, 1), (5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit_quality(edge, labels)
    got = quality.score_quality(edge, model).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    empty = quality.fit_quality(none, labels.where("quality > 5"))
    assert all(abs(r.score - 0.5) < 0.05 for r in quality.score_quality(edge, empty).collect())


def test_language_held_out(spark, sf):
    big = sf.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.QUERIES["op7_language_families"](spark, big).collect()}
    d = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang").collect()
    held = [got[r.doc_id].lang_pred == r.lang for r in d if got[r.doc_id].held_out]
    assert np.mean(held) >= 0.98 and all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())


def test_language_edges(spark, edge, none, docs):
    model = langid.fit_languages(docs)
    assert langid.contests(["en", "de", "fr", "xx"], langid.FAMILIES) == [("", "germanic", "romance"), ("", "germanic", "xx"), ("", "romance", "xx"), ("germanic", "de", "en")]
    got = {r.doc.doc_id: r for r in langid.identify(edge, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[8].lang_pred in model["langs"]
    nothing = langid.fit_languages(none.withColumn("lang", F.lit("en")))
    assert {r.lang_pred for r in langid.identify(edge, nothing).collect()} == {"und"}
    one = langid.fit_languages(docs.where("lang = 'fr'"))
    assert {r.lang_pred for r in langid.identify(docs, one).collect()} == {"fr"}
    assert langid.identify(none, model).count() == 0


# -- 5 tool calls


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        ("c", "a", 1, "f", '{"n": 1.0, "s": "x"}'), ("c", "b", 2, "f", '{"s": "x", "n": 2, "after": {"$ref": "a"}}'), ("c", "d", 3, "g", "{}"), ("c", "e", 4, "f", "not json"), ("c", "x", 5, "f", '{"n": {"$ref": "y"}}'),
        ("c", "y", 6, "f", '{"n": {"$ref": "x"}}'), (None, "a", 7, "f", "{}"), ("c", None, 8, "f", None)], "conv_id string, call_id string, pos int, name string, arguments string")
    results = spark.createDataFrame([("c", "a", 9, "late"), ("c", "a", 5, "first"), ("c", "zz", 6, None), (None, "a", 7, "n")], "conv_id string, call_id string, pos int, content string")
    schemas = {"f": {"properties": {"n": {"type": "integer", "maximum": 1}, "s": {"type": "string"}, "after": {"type": "object"}}, "required": ["n"], "additionalProperties": False}}
    got = {(r.conv_id, r.call_id, r.status): r for r in tool_calls.link_tool_calls(calls, results, schemas).collect()}
    a = got["c", "a", "linked"]
    assert a.level == 0 and a.n_results == 2 and '"content":"first"' in a.message and a.message.startswith('{"arguments":{"n":1,"s":"x"}') and a.errors == []
    assert got["c", "b", "unanswered"].level == 1 and got["c", "b", "unanswered"].errors == ["n too large"]
    assert got["c", "d", "unanswered"].errors == ["unknown tool"] and got["c", "e", "unanswered"].errors == ["arguments are not an object"]
    assert got["c", "x", "unanswered"].level is None and got["c", "y", "unanswered"].level is None
    assert ("c", "zz", "orphan") in got and len(got) == 10
    assert tool_calls.link_tool_calls(calls.where("pos < 0"), results.where("pos < 0"), schemas).count() == 0


def test_levels_of_long_chains(spark):
    random.seed(3)
    deps = {i: sorted({random.randrange(max(0, i - 4), i) for _ in range(random.choice([0, 1, 1, 2]))}) if i else [] for i in range(60)}
    deps |= {1000 + i: [999 + i] if i else [] for i in range(70)} | {500: [501], 501: [502], 502: [500], 503: [502]}
    df = spark.createDataFrame([("c", str(k), [str(x) for x in v] + ["unknown"]) for k, v in deps.items()], "conv_id string, call_id string, depends array<string>")
    want = {}
    for k in sorted(deps):
        if not 500 <= k <= 503:
            want[k] = max([want[x] + 1 for x in deps[k]], default=0)
    assert {int(r.call_id): r.level for r in tool_calls.order_calls(df, ["conv_id", "call_id"]).collect()} == want


def test_schemas(spark):
    schema = {
        "properties": {
            "x.y": {"type": "integer"}, "n": {"enum": [1, "a", None]}, "any": {},
            "list": {"type": "array", "maxItems": 2, "items": {"type": "object", "properties": {"k": {"type": ["string", "null"], "pattern": "^a"}}, "required": ["k"]}},
            "o": {"anyOf": [{"type": "string"}, {"type": "number", "exclusiveMinimum": 0}]},
        },
        "additionalProperties": {"type": "boolean"},
    }
    cases = {
        '{"x.y":1,"n":null,"any":[1],"list":[{"k":"ab"},{"k":null}],"o":"s","z":true}': [],
        '{"x.y":"1","n":2,"o":-1,"z":0}': ["x.y is not integer", "n not allowed", "o fits no option", "* is not boolean"],
        '{"x.y":1.0,"list":[{"k":"b"},{},{"k":1}],"o":0.5}': ["list too long", "list[].k does not match", "missing list[].k", "list[].k is not string or null"],
        "[]": ["arguments are not an object"], "{": ["arguments are not an object"],
    }
    df = spark.createDataFrame([(i, "t", a) for i, a in enumerate(cases)], "i int, name string, arguments string")
    got = {r.i: r.errors for r in tool_calls.validate_arguments(df, {"t": schema}).collect()}
    assert {i: sorted(e) for i, e in got.items()} == {i: sorted(e) for i, e in enumerate(cases.values())}
    with pytest.raises(ValueError):
        tool_calls.validate_arguments(df, {"t": {"uniqueItems": True}})


def test_repeated_calls_and_long_texts(spark):
    call = lambda i, a, extra=0: ("c", i, 1, "t", a, extra)
    calls = spark.createDataFrame([call("a", "{}"), call("b", '{"p":{"$ref":"a"}}'), call("d", '{"p":{"$ref":"a"}}'), call("d", '{"p":{"$ref":"b"},"q":"%s"}' % LONG)], "conv_id string, call_id string, pos int, name string, arguments string, level int")
    results = spark.createDataFrame([("c", "a", 2, LONG)], "conv_id string, call_id string, pos int, content string")
    got = tool_calls.link_tool_calls(calls, results, {"t": {}}).collect()
    assert sorted((r.call_id, r.level, r.status) for r in got) == [("a", 0, "linked"), ("b", 1, "unanswered"), ("d", 2, "unanswered"), ("d", 2, "unanswered")]


# -- 6 similarity join


def brute_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = SPACED.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and k * den >= (len(sets[i]) + len(sets[j]) - k) * num:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_join_brute_force(spark, n, num, den):
    rng = random.Random(n)
    vocab = ["w%d" % i for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 30, 120]))]
        for _ in range(rng.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 12) + 1)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [w[k], rng.choice(vocab)]])
                w = w or ["x"]
            texts.append(" ".join(w))
    texts += [None, "", "  ", "a b", "A  B", "a b c", LONG, LONG]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, sizes = brute_components(texts, n, num, den)
    got = sorted(jaccard_join.jaccard_join(df, n=n, num=num, den=den)["members"].collect(), key=lambda r: r.id)
    assert [r.component for r in got] == want and [r.size for r in got] == sizes


def test_join_edges(spark, edge, none):
    got = jaccard_join.keep_one_per_group(edge)
    assert got.columns == edge.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "3", "4", "5", "7", "8"]
    assert jaccard_join.jaccard_join(none)["members"].count() == 0
    assert jaccard_join.keep_one_per_group(none).count() == 0


def test_many_near_copies_stay_linear(spark):
    rng = random.Random(1)
    base = ["w%d" % i for i in range(200)]
    texts = [" ".join(base[:k] + [f"u{i}"] + base[k + 1 :]) for i, k in enumerate(rng.randrange(200) for _ in range(400))]
    out = jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=4, num=85, den=100)
    assert out["members"].where("component <> 0").count() == 0 and out["links"].count() < 400 * 20


def test_join_keeps_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (3, "", "z", 3)], "doc_id long, `te.xt` string, _row string, `a.b` int")
    got = jaccard_join.keep_one_per_group(df, text_col="te.xt")
    assert got.columns == df.columns and sorted((r.doc_id, r._row) for r in got.collect()) == [(1, "x"), (3, "z")]


# -- 8 sharding


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 10))
def test_feistel(n, seed):
    p = sharding.feistel(np.arange(n), n, seed)
    assert sorted(p.tolist()) == list(range(n)) and (sharding.feistel_inverse(p, n, seed) == np.arange(n)).all()


def test_shards(spark, edge, none):
    got = sharding.shard_documents(edge, shards=4).collect()
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(4)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert all(r.size == 16 + len((t or "").encode()) for r in got for i, t, _, _ in EDGE if r.id == i and i not in (None,))
    again = sharding.shard_documents(edge.repartition(3), shards=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and sharding.shard_documents(none).count() == 0


# -- 9 media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000), st.integers(1, 5000))
def test_container_round_trip(payload, chunk):
    data = media.store(payload, chunk=chunk)
    (t,) = media.tracks(data)
    assert media.samples(data, t) == payload and t["n_samples"] == t["ticks"] == len(payload) and t["codec"] == "raw"
    ranges = media.keyframe_ranges(t)
    assert sum(b - a for a, b in ranges) == len(payload) and len(ranges) <= 1


def test_other_containers():
    box, full = media._box, media._full
    import struct

    sizes = [5, 7, 3, 9]
    def moov(base):
        stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(8))), full(b"stts", struct.pack(">III", 1, 4, 100)), full(b"stsc", struct.pack(">I", 2), struct.pack(">III", 1, 3, 1), struct.pack(">III", 2, 1, 1)), full(b"stsz", struct.pack(">II", 0, 4), struct.pack(">4I", *sizes)), full(b"stco", struct.pack(">I", 2), struct.pack(">II", base, base + 20)), full(b"stss", struct.pack(">I", 2), struct.pack(">II", 1, 4)))
        return box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIIII", 0, 0, 1000, 400, 0)), box(b"minf", stbl))))
    base = len(moov(0)) + 8
    data = moov(base) + box(b"mdat", bytes(range(40)))
    (t,) = media.tracks(data)
    assert (t["codec"], t["scale"], t["ticks"]) == ("avc1", 1000, 400) and t["offsets"].tolist() == [base, base + 5, base + 12, base + 20]
    assert media.keyframe_ranges(t) == [(base, base + 5), (base + 20, base + 29)]
    for broken in (b"", b"\0\0\0\x08moov", data[:30], b"\xff" * 64):
        assert media.tracks(broken) == [] or media.tracks(broken)[0]["n_samples"] >= 0


def test_media_query(spark, edge, none):
    got = media.probe(media.store_texts(edge)).collect()
    assert len(got) == len(EDGE)
    for r in got:
        raw = (r.row.doc.text or "").encode()
        p = media.padded(raw)
        assert r.row.n_bytes == len(raw) and r.payload_bytes == len(p) > 0 and len(p) % 64 == 0 and r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-64:])
    assert media.probe(media.store_texts(none)).count() == 0


# -- 10 decontamination


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=0, max_size=200), st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=6), min_size=1, max_size=10))
def test_fm_index(seq, phrases):
    text = np.array(seq + [0])
    index = fm_index.FMIndex(text, 6)
    width = max(map(len, phrases))
    table = np.array([p + [0] * (width - len(p)) for p in phrases])
    lo, hi = index.ranges(table, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, lo, hi):
        want = [i for i in range(len(seq) - len(p) + 1) if seq[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_leaks_and_removal(spark, edge, none, monkeypatch):
    item = " ".join(f"k{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item), (1, item), (2, "Solo words"), (3, None), (4, "..."), (None, "k5 k6")], "item_id long, text string")
    d = spark.createDataFrame([(100, f"pre {item} post", "q", 1), (101, " ".join(f"k{i}" for i in range(9)), "q", 1), (102, "SOLO, words!", "q", 1), (103, item, "q", 1)], edge.schema).unionByName(edge)
    found = {r.doc.doc_id: r for r in fm_index.find_leaks(d, bench).collect()}
    words = lambda r: sum(s.end - s.start for s in r.spans)
    assert words(found[100]) == 14 and found[100].items == ["1"] and words(found[101]) == 2 and found[101].items == [] and found[102].items == ["2"] and words(found[5]) == 0
    clean = fm_index.remove_leaks(d, bench)
    assert clean.columns == d.columns and fm_index.find_leaks(clean, bench).where("size(spans) > 0").count() == 0
    left = {r.doc_id: r.text for r in clean.collect()}
    assert left[100].split() == ["pre", "post"] and 103 not in left and 102 not in left and left[4] == "One" and 1 in left
    monkeypatch.setattr(fm_index, "BLOCK_ITEMS", 2)
    many = {r.doc.doc_id: r for r in fm_index.find_leaks(d, bench).collect()}
    assert all(words(many[k]) == words(found[k]) and many[k].items == found[k].items for k in found)
    assert fm_index.find_leaks(none, bench).count() == 0 and fm_index.find_leaks(d, bench.where("item_id > 99")).where("size(spans) > 0").count() == 0


# -- pipeline


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as P
    from quayside.functions.scratch import materialize

    now, seen = docs, {}
    for name, stage in P.STAGES:
        now = materialize(stage(spark, now, sf), name)
        seen[name] = now
        if name != "packing":
            assert now.columns == docs.columns and now.join(docs, "doc_id", "left_anti").count() == 0
    texts = {r.doc_id: r.text for r in seen["language"].collect()}
    ids = sorted(texts)
    want, _ = brute_components([texts[k] for k in ids], 5, 4, 5)
    assert {r.doc_id for r in seen["near_duplicates"].collect()} == {ids[i] for i in set(want)}
    assert fm_index.find_leaks(seen["decontamination"], spark.read.parquet(f"{sf}/benchmark.parquet")).where("size(spans) > 0").count() == 0
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} == {r.doc_id for r in seen["decontamination"].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality"].collect()}
    assert np.mean([(k in kept) == (y == 1) for k, y in labels.items()]) > 0.95
