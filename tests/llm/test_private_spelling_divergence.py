"""Ops 11 to 13 against plain Python versions, and on edge cases."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quayside.llm import divergence, private, spelling

# --- 11: personal data

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def plain_base(text):
    return {kind: [m.span() for m in re.finditer(rule, text or "") if holds(kind, m.group())] for kind, rule in RULES.items()}


def found(df, **names):
    return {r.id: r for r in private.find_private(df, **names).collect()}


def test_base_spans(spark):
    rng = random.Random(3)
    texts = [None, "", "@", "a@b", "a@b.c", "a@b.c_d@e.f", "x@y..z", "a@b@c.d", "é@a.b ü.c@d.e", "𝒳 a@b.c 1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "000.00255.1.1", "1.2.3.256", "1.2.3"]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111  1111", "411111111111", "+1 (310) 555-4510 x", "+12", "+1((((9", "+++1 234 567 890", "+49.30.1234567)"]
    texts += ["".join(rng.choice("ab1.@+- (0é\n_") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(200)) for _ in range(40)]
    texts += [" ".join(rng.choice(["a@b.cc", "10.0.0.1", "no", "+1 555 444 3333"]) for _ in range(1300))]
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert {kind: [tuple(s) for s in got[i][kind]] for kind in RULES} == plain_base(text), text


def test_discovered_identifiers(spark):
    texts = [f"write to user{k}@mail{k}.example now" for k in range(25)]
    texts += [f"call me: +49 30 5550{k:03d} today" for k in range(25)]
    texts += ["write to root@localhost now", "call me: 030 5559876 today", "write to nobody now", "sum 0305559876 of it", "again 030 5559876 elsewhere", None]
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    added = {texts[i][s.start : s.end]: private.KINDS[s.kind] for i in got for s in got[i].added}
    # What a trusted pattern stands beside is known, and then wherever it stands; its neighbours in other contexts are not.
    assert added == {"root@localhost": "email", "030 5559876": "phone"}
    assert [len(got[i].added) for i in (50, 51, 52, 53, 54, 55)] == [1, 1, 0, 0, 1, 0]
    for r in got.values():
        assert all(a.end <= b.start or b.end <= a.start for a in r.added for kind in RULES for b in r[kind])


def plain_rounds(edges, seeds, fits):
    degree, found_now = Counter(p for p, _ in edges), {}
    for _ in range(private.ROUNDS):
        known = {v: (k, 1000) for v, k in seeds.items()} | found_now
        sums = Counter()
        for p, v in edges:
            if v in known:
                sums[p, known[v][0]] += known[v][1]
        trusted = {p: (k, s // (degree[p] + 1)) for (p, k), s in sums.items() if s // (degree[p] + 1) >= private.LEAST}
        best = {}
        for p, v in edges:
            if p in trusted and v not in seeds and trusted[p][0] in fits[v]:
                best[v] = max(best.get(v, (0, 0)), (trusted[p][1], -trusted[p][0]))
        found_now = {v: (-k, c) for v, (c, k) in best.items()}
    return found_now


def test_rounds(spark):
    rng = random.Random(5)
    for trial in range(3):
        values = [f"v{i}" for i in range(120)]
        seeds = {v: rng.randrange(2) for v in values[:80]}
        fits = {v: rng.sample(range(4), rng.randint(0, 3)) + [0] * (rng.random() < 0.5) for v in values}
        edges = {(f"p{(seeds.get(v, rng.randrange(2)) * 4 + rng.randrange(4)) % 8}", v) for v in values for _ in range(2)}
        edges |= {(f"q{rng.randrange(3)}", v) for v in values[70:95]}
        e = spark.createDataFrame(sorted(edges), "pattern string, value string")
        v = spark.createDataFrame([(x, seeds.get(x), fits[x]) for x in values], "value string, seed int, fits array<int>")
        assert {r.value: (r.kind, r.score) for r in private.discover(e, v).collect()} == plain_rounds(sorted(edges), seeds, fits)


def test_private_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert private.find_private(empty).count() == 0
    df = spark.createDataFrame([(1, "a@b.c", "x", "y"), (1, "a@b.c", "x", "y"), (None, None, None, None)], "`i.d` long, `te.xt` string, email string, instances string")
    rows = private.find_private(df, "i.d", "te.xt").collect()
    assert sorted((r.id or 0, len(r.email), len(r.added)) for r in rows) == [(0, 0, 0), (1, 1, 0), (1, 1, 0)]
    hostile = ["a" * 300_000, "1" * 300_000, "(" * 300_000 + "@", "a@" * 150_000, "+1" + "(" * 300_000, "1 " * 150_000, "1." * 150_000]
    began = time.time()
    got = found(spark.createDataFrame(list(enumerate(hostile)), "doc_id long, text string"))
    assert [sum(len(got[i][kind]) for kind in RULES) for i in range(len(hostile))] == [0, 0, 0, 0, 0, 0, 37_500]
    assert time.time() - began < 60


# --- 12: spelling variants


def near(a, b):
    """One edit apart, exactly?"""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_groups(counts):
    forms, out = {}, {}
    for w, n in counts.items():
        others = [u for u in counts if near(w, u)]
        best = min(others, key=lambda u: (-counts[u], u), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * n else None
        out[w] = [n, len(others), forms[w], counts[best] if forms[w] else None]
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out[w].append(root)
    return {w: tuple(x) for w, x in out.items()}


def test_groups_by_brute_force(spark):
    rng = random.Random(1)
    counts = {}
    while len(counts) < 700:
        w = "".join(rng.choice("aab\xe9") for _ in range(rng.randint(7, 10)))
        counts[w] = rng.choice([2, 3, 25, 40, 300, 5000])
    base = "".join(rng.choice("abcd") for _ in range(41))
    # Words on both sides of the trie's bound, with runs of one letter, and some far beyond it.
    for w in {base[:40], base, base[:20] + base[21:], base[:39] + "zz", base[:39] + "z", base + "a", "x" + base, "q" * 39, "q" * 40, "q" * 41, "q" * 42, "ab" * 3000, "ab" * 2999 + "a", "ab" * 2999 + "ac"}:
        counts[w] = rng.choice([2, 60, 700])
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group_spellings(words).collect()}
    assert got == plain_groups(counts)
    assert sum(x[1] for x in got.values()) > 1000 and any(x[2] for x in got.values())


def test_chains_of_forms(spark):
    counts = {"aaaaaaa" + "b" * k: 2 * 10**k for k in range(12)}
    got = {r.word: r for r in spelling.group_spellings(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert {r.root for r in got.values()} == {"aaaaaaa" + "b" * 11} and got["aaaaaaa"].form == "aaaaaaab"


def test_words(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["Motoring", "großarten", "ÉCOLIERES", "ab", "seventy", "x" * 50]) for _ in range(60))) for i in range(300)] + [(400, None), (None, "Motoring motoring"), (401, ""), (0, "motoring")]
    want = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            want[run if h % 31 else run[:at] + run[at + 1 :]] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    df = spark.createDataFrame(rows, "`d.id` long, text string").withColumn("word", F.lit("x"))
    assert {r.word: r.n for r in spelling.count_words(df, "d.id").collect()} == want
    assert any(len(w) == 49 for w in want)


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_spellings(spelling.count_words(empty)).count() == 0


# --- 13: sources


def plain_audit(rows, least, top):
    tf, df, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        for t in terms:
            tf[lang, source, t] += 1
        for t in set(terms):
            df[lang, t] += 1
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= least:
            kept[lang].append(t)
    share = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    by_lang = Counter()
    for (lang, source, t), n in tf.items():
        by_lang[lang, t] += n
    out = set()
    p = {(g, t): share(tf[(*g, t)], sum(tf[(*g, x)] for x in kept[g[0]]), len(kept[g[0]])) for g in groups for t in kept[g[0]]}
    for g in groups:
        terms = kept[g[0]]
        pairs = [(sum(abs(p[g, t] - p[h, t]) for t in terms), h[1]) for h in groups if h[0] == g[0] and h != g]
        q = {t: share(by_lang[g[0], t], sum(by_lang[g[0], x] for x in terms), len(terms)) for t in terms}
        above = [(p[g, t] - q[t], t) for t in terms if tf[(*g, t)] and p[g, t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", above, top)):
            out |= {(*g, part, item, value, i + 1) for i, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most])}
    return out


@pytest.mark.parametrize("cells", [1 << 20, 8])
def test_sources_by_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", (1, cells))
    rng = random.Random(4)
    words = ["Alpha", "beta", "γάμμα", "d", "Ünder", "zz", "alpha1", "rare", "\x80x", "q_q"]
    rows = [(rng.choice(["en", "de", None, "", "x"]), rng.choice(["s1", "s2", "s3", None]), rng.choice([None, "", *[" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(6)]])) for _ in range(160)]
    rows += [("lone", "s1", "alpha alpha"), ("few", "s1", "unheard"), ("few", "s2", "words"), *[("en", "s1", "Alpha\x00beta")] * 3]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "lang string, source string, text string, term string, n int")
    got = {tuple(r) for r in divergence.audit_sources(df, least_docs=12, top=3).collect()}
    assert got == plain_audit(rows, 12, 3)
    assert {r[2] for r in got} == {"pair", "term"} and any(r[:3] == ("few", "s1", "pair") and r[4] == 0 for r in got)


def test_sources_of_nothing(spark):
    assert divergence.audit_sources(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    raw = ("Ab cé 1" * 5000 + "x" * 300).encode()
    assert divergence.frequencies(raw, 64) == divergence.frequencies(raw) == Counter(raw.translate(divergence.TABLE).split())
    assert divergence.frequencies(b"") == Counter()
