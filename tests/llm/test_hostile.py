"""Input from outside: licence lines, archives and containers that are wrong on purpose."""

import itertools
import random

import struct
import tracemalloc

import numpy as np
import pytest

from quayside.llm import licenses, media, warc
from test_brute_force import track

# --- 1: licence expressions

def plain_parse(tokens):
    """Every head by recursive descent; the longest that parses gives (labels, tree)."""

    def either(i):
        got = both(i)
        while got and got[0] < len(toks) and toks[got[0]].lower() == "or":
            more = both(got[0] + 1)
            got = more and (more[0], ("or", got[1], more[1]))
        return got

    def both(i):
        got = one(i)
        while got and got[0] < len(toks) and toks[got[0]].lower() == "and":
            more = one(got[0] + 1)
            got = more and (more[0], ("and", got[1], more[1]))
        return got

    def one(i):
        if i < len(toks) and toks[i] == "(":
            got = either(i + 1)
            return (got[0] + 1, got[1]) if got and got[0] < len(toks) and toks[got[0]] == ")" else None
        if i >= len(toks) or toks[i].lower() in ("and", "or", "with", "(", ")"):
            return None
        if i + 1 < len(toks) and toks[i + 1].lower() == "with":
            ok = i + 2 < len(toks) and toks[i + 2].lower() not in ("and", "or", "with", "(", ")")
            return (i + 3, (toks[i], toks[i + 2])) if ok else None
        return i + 1, (toks[i], "")

    for n in range(len(tokens), 0, -1):
        toks = tokens[:n]
        got = either(0)
        if got and got[0] == n:
            return got[1]
    return None

def names(tree):
    return names(tree[1]) | names(tree[2]) if tree[0] in ("and", "or") else {tree[0].lower()}

def test_heads_by_brute_force():
    rng = random.Random(7)
    alphabet = ["MIT", "A", "B", "and", "OR", "with", "(", ")"]
    lists = [list(x) for n in range(1, 5) for x in itertools.product(alphabet, repeat=n)] + [[rng.choice(alphabet) for _ in range(rng.randint(5, 14))] for _ in range(4000)]
    for tokens in lists:
        tree, got = plain_parse(tokens), licenses.parse_expression(" ".join(tokens))
        assert (got is None) == (tree is None), tokens
        if tree:
            assert got[0] == sorted(names(tree)), tokens
            again = licenses.parse_expression(got[1])
            assert again == got, tokens  # the canonical form is its own

@pytest.mark.parametrize("text, labels", [("GPL-2.0 WITH B OR B", ["b", "gpl-2.0"]), ("MIT OR A WITH (B OR C)", ["a", "mit"]), ("(MIT) WITH B", ["mit"]), ("A WITH B WITH C", ["a"]), ("WITH B", None), ("MIT AND WITH", ["mit"])])
def test_exceptions_by_place(text, labels):
    got = licenses.parse_expression(text)
    assert (got and got[0]) == labels

# --- 2: archives

def member(head, block):
    return warc._gzip(head + b"\r\n\r\n" + block + b"\r\n\r\n", 4)

def test_lengths_that_are_none(spark):
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: "
    bad = ["²", "٣", "9" * 5000, "-1", "", "1e3", "+5"]
    data = b"".join(member(head + b.encode(), b"hello") for b in bad) + member(head + b"5", b"hello")
    rows = warc.read_archives(spark.createDataFrame([(bytearray(data),)], "warc binary")).collect()
    assert [r.problem for r in rows] == ["not a WARC record"] * len(bad) + [None] and bytes(rows[-1].payload) == b"hello"
    for length in [b"9" * 5000, "²".encode()]:
        block = warc.arc_version_block(1, "x", "2024")
        arc = block + b"http://a/ 1.1.1.1 2024 text/html " + length + b"\nhello\nhttp://b/ 1.1.1.1 20240101 text/html 2\nok\n"
        got = list(warc.parse_arc(arc))
        assert [r["problem"] is None for r in got] == [False, True] and got[-1]["block"] == b"ok"
        assert [r["problem"] for r in warc.parse_arc(b"filedesc://x 0 2024 text/plain " + length + b"\n1 0 x\n")] == ["no version block of a known version"]
    assert warc.warc_date("٢٠٢٤٠١٠١") == warc.warc_date("x") == "1970-01-01T00:00:00Z"

def test_header_line_of_many_blanks():
    fields = warc.ARC_FIELDS[1]
    assert warc._header(b"http://a b/ c 1.1.1.1 20240101 text/html; charset=x 12", fields) == [b"http://a b/ c", b"1.1.1.1", b"20240101", b"text/html; charset=x", b"12"]
    assert warc._header(b" " * 400_000 + b"5", fields) is None

def test_member_that_unpacks_to_too_much(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1 << 20)
    data = warc._gzip(b"WARC/1.1\r\n" + bytes(60 << 20), 9) + member(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5", b"hello")
    tracemalloc.start()
    got = list(warc.parse_warc(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [p for _, _, p in got] == ["member larger than MEMBER_BYTES", None] and got[1][1] == b"hello" and peak < 40 << 20

def test_revisits_with_clashing_names(spark):
    rows = [("a", bytearray(b"x"), "d1", 1, "p"), ("b", bytearray(b"x"), "d1", 2, "q"), ("c", bytearray(b""), "d2", None, None)]
    df = spark.createDataFrame(rows, "record_id string, payload binary, payload_digest string, _rank int, _best string").withColumnsRenamed({})
    df = df.withColumn("rank", df["_rank"]).withColumn("best", df["_best"])
    got = {r.record_id: r for r in warc.mark_revisits(df, df["_rank"]).collect()}
    assert {k: (r.refers_to, r._rank, r._best, r.rank, r.best) for k, r in got.items()} == {"a": ("b", 1, "p", 1, "p"), "b": (None, 2, "q", 2, "q"), "c": (None, None, None, None, None)}
    assert warc.mark_revisits(df.limit(0), df["_rank"]).count() == 0

# --- 9: containers

full, box = media._full, media._box

def peak_of(data):
    tracemalloc.start()
    said = media.describe(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return said, peak

def fragment(number, *truns, flags=0x10, fields=(1,)):
    return box(b"moof", box(b"traf", full(b"tfhd", struct.pack(f">I{len(fields)}I", number, *fields), flags=flags), *truns))

def test_declared_counts_hold_no_memory():
    tables = [full(b"stsz", struct.pack(">II", 1, 0xFFFFFFFF)), full(b"stsc", struct.pack(">I", 1), struct.pack(">III", 1, 0xFFFFFFFF, 1)), full(b"stco", struct.pack(">II", 1, 0))]
    data = box(b"moov", track(1, b"vide", b"avc1", tables)) + fragment(1, full(b"trun", struct.pack(">I", 1)))
    said, peak = peak_of(data)
    assert said["codec"] == "avc1" and peak < 8 << 20
    traf = box(b"traf", full(b"tfhd", struct.pack(">II", 1, 1), flags=0x10), full(b"trun", struct.pack(">I", 4_000_000_000)))
    said, peak = peak_of(box(b"moov", track(1, b"vide", b"avc1", [])) + box(b"moof", *[traf] * 20_000))
    assert peak < 50 << 20
    runs = full(b"stsc", struct.pack(">I", 20_000), b"".join(struct.pack(">III", 1, k, 1) for k in range(20_000)))
    many = [full(b"stsz", struct.pack(">II", 1, 100)), runs, full(b"stco", struct.pack(">I", 50_000), bytes(200_000))]
    said, peak = peak_of(box(b"moov", track(1, b"vide", b"avc1", many)))
    assert peak < 50 << 20

def test_boxes_at_any_depth():
    def deep(n):
        stsd = full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(16)))
        for _ in range(n):
            stsd = box(b"minf", stsd)
        return box(b"moov", box(b"trak", stsd))

    assert [media.tracks(deep(n))[0]["codec"] for n in (1, 15, 40, 5000)] == ["avc1"] * 4

def test_first_flags_of_a_run():
    movie = box(b"moov", track(1, b"vide", b"avc1", []))
    head = len(movie) + len(fragment(1, full(b"trun", struct.pack(">III", 3, 0, 0), flags=5), flags=0x30, fields=(4, 0x10000))) + 8
    data = movie + fragment(1, full(b"trun", struct.pack(">IiI", 3, head - len(movie), 0), flags=5), flags=0x30, fields=(4, 0x10000)) + box(b"mdat", b"KEYSabcdefgh")
    said = media.describe(data)
    assert [data[k["start"] : k["end"]] for k in said["keyframes"]] == [b"KEYS"] and said["n_samples"] == 3
    assert said["payload_bytes"] == 12

def test_fuzzed_fragments(spark):
    rng = np.random.default_rng(11)
    trun = full(b"trun", struct.pack(">IiI", 3, 8, 0), struct.pack(">3I", 6, 4, 2), flags=0x205)
    movie = box(b"moov", track(1, b"vide", b"avc1", [full(b"stsz", struct.pack(">II", 1, 3)), full(b"stsc", struct.pack(">4I", 1, 1, 3, 1)), full(b"stco", struct.pack(">II", 1, 9))]))
    whole = np.frombuffer(movie + fragment(1, trun, full(b"trun", struct.pack(">I", 2))) * 3 + box(b"mdat", bytes(range(60))), np.uint8)
    broken = []
    for _ in range(3000):
        some = whole.copy()
        some[rng.integers(0, len(some), 4)] = rng.choice([0, 1, 127, 128, 255, int(rng.integers(0, 256))], 4)
        broken.append(bytearray(some.tobytes()))
    rows = media.probe(spark.createDataFrame([(b,) for b in broken], "media binary")).collect()
    assert len(rows) == 3000 and all(r.payload_bytes <= r.media_bytes for r in rows)

