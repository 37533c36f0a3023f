"""Personal data by bootstrapped contextual extraction. DataFrame functions only.

Addresses, network numbers, cards and phone numbers that a strict rule knows (the base) are the seeds. Every identifier-like
piece of text, seed or not, is an instance; the words around its places are its patterns. Patterns and instances make a
graph that is scored in rounds: a pattern's confidence in a kind is the summed score of its known instances over the number
of all its instances, plus one; a pattern of LEAST or more is trusted, and an instance next to a trusted pattern becomes
known, with that confidence as its score, and takes part in the next round. Scores are whole thousandths, so sums and
comparisons are exact.

Places are found without row-wise code: a text is split at a pattern, and running sums of the lengths of the parts and of
the matches give the places of the matches, in code points. Texts are read once; the rounds work on a table of instances.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.scratch import discard, materialize
from quayside.llm import tokens as T

KINDS = ["email", "ip", "card", "phone"]
LEAST = 900  # thousandths; with the one added below, nine known instances at least
ROUNDS = 4
CONTEXT = 48  # code points on either side in which words of the context are looked for
SHORTEST, LONGEST = 5, 64  # code points of an instance

_LOCAL = "A-Za-z0-9._%+-"
#: What no match of the base can begin behind, and quantifiers that give nothing back, keep the search linear in the text; the
#: matches are those of the plain rules.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"
_SPACE = r"\x09-\x0D\x20"
#: A piece of text between blanks with a digit or an @, and groups of digits that follow it.
INSTANCE = rf"(?:\G|(?<![^{_SPACE}]))[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+(?: \(?[0-9][0-9().-]*+)*+"
_ENDS = r"0-9A-Za-z\x{80}-\x{10FFFF}"
_LEAD = rf"^[^+({_ENDS}]*"
_TRIMMED = rf"(?s){_LEAD}([+({_ENDS}].*[{_ENDS}])"
_STEP = 512


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    """Does a match of the kind's rule pass the kind's check?"""
    if kind == "ip":
        return value.rlike(_IP_PARTS)
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & F.call_function("luhn_check", _digits(value))
    return F.length(_digits(value)).between(9, 15) if kind == "phone" else F.lit(True)


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _running_sums(sizes: Column) -> Column:
    """Sums of the first 1, 2, ... values; long arrays go by steps of _STEP, whose sums are kept."""
    total = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x)
    steps = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _STEP).cast("int"))
    step_sums = F.transform(steps, lambda k: total(F.slice(sizes, k * _STEP + 1, F.lit(_STEP))))
    before = F.aggregate(step_sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    at = lambda i: (i / _STEP).cast("int")
    return _let(before, lambda b: F.transform(sizes, lambda _, i: F.get(b, at(i)) + total(F.slice(sizes, at(i) * _STEP + 1, i % _STEP + 1))))


def _placed(text: Column, pattern: str, told: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """``told(match, start, gaps, number)`` of each match; ``gaps``: the texts before, between and behind the matches."""

    def with_gaps(hits: Column, gaps: Column) -> Column:
        sizes = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(0))
        return _let(_let(sizes, _running_sums), lambda starts: F.transform(hits, lambda h, i: told(h, F.get(starts, i), gaps, i)))

    split = lambda hits: _let(F.split(text, pattern, -1), lambda gaps: with_gaps(hits, gaps))
    return _let(_matches(text, pattern), lambda hits: F.when(F.size(hits) > 0, split(hits)))


def _base(text: Column, kind: str) -> Column:
    place = lambda h, start, gaps, i: F.struct(start.alias("start"), (start + F.length(h)).alias("end"), _holds(kind, h).alias("holds"))
    found = F.filter(_placed(text, BASE[kind], place), lambda m: m["holds"])
    plain = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return F.coalesce(plain, F.array().cast("array<struct<start:int,end:int>>"))


def _words(part: Column) -> Column:
    low = F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, f"[{_SPACE}]+", -1), lambda w: w != "")


def _instances(text: Column) -> Column:
    """Identifier-like pieces with their places and up to two words before and one behind, null where there are none."""

    def one(hit: Column, start: Column, gaps: Column, i: Column) -> Column:
        value = F.regexp_extract(hit, _TRIMMED, 1)
        begin = start + F.length(F.regexp_extract(hit, _LEAD, 0))
        before, behind = _words(F.right(F.get(gaps, i), F.lit(CONTEXT))), _words(F.left(F.get(gaps, i + 1), F.lit(CONTEXT)))
        return F.struct(
            begin.alias("start"), (begin + F.length(value)).alias("end"), value.alias("value"), F.try_element_at(before, F.lit(-2)).alias("l2"), F.try_element_at(before, F.lit(-1)).alias("l1"), F.get(behind, F.lit(0)).alias("r1")
        )

    found = F.filter(_placed(text, INSTANCE, one), lambda m: F.length(m["value"]).between(SHORTEST, LONGEST))
    return F.coalesce(found, F.array().cast("array<struct<start:int,end:int,value:string,l2:string,l1:string,r1:string>>"))


def _seed(value: Column) -> Column:
    """Number of the first kind that the base finds in an instance, null if none."""
    found = F.lit(None).cast("int")
    for number, kind in reversed(list(enumerate(KINDS))):
        found = F.when(F.exists(_matches(value, BASE[kind]), lambda h: _holds(kind, h)), F.lit(number)).otherwise(found)
    return found


def _fits(value: Column) -> Column:
    """Numbers of the kinds that an instance may be of, by its signs alone."""
    n, bare = F.length(_digits(value)), F.regexp_replace(value, "[ ().+-]", "")
    numeric = ~bare.rlike("[^0-9]")
    rules = [value.contains("@"), (n >= 4) & value.rlike("[.:]") & ~value.contains("@"), numeric & n.between(12, 19), numeric & n.between(7, 15)]
    return F.array_compact(F.array(*[F.when(rule, F.lit(number)) for number, rule in enumerate(rules)]))


def discover(edges: DataFrame, values: DataFrame, least: int = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """``(value, kind, score)`` of instances that no seed is in, but a trusted pattern beside.

    ``edges``: distinct ``(pattern, value)``; ``values``: distinct ``value`` with ``seed`` (number of a kind or null) and
    ``fits`` (numbers of the kinds it may be of). Of several kinds that with the highest confidence counts, then the first.
    Ends when nothing changes, or after ``rounds``.
    """
    degrees = materialize(edges.groupBy("pattern").agg(F.count("*").alias("n")), "degrees")
    seeds = values.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1000).cast("long").alias("score"))
    unknown = values.where("seed is null and size(fits) > 0").select("value", "fits")
    found, before = None, None
    for _ in range(rounds):
        known = seeds.unionByName(found) if found is not None else seeds
        sums = edges.join(known.hint("merge"), "value").groupBy("pattern", "kind").agg(F.sum("score").alias("score"))
        trusted = sums.join(degrees.hint("merge"), "pattern").selectExpr("pattern", "kind", f"score div (n + 1) AS confidence").where(F.col("confidence") >= least)
        reached = edges.join(trusted, "pattern").groupBy("value", "kind").agg(F.max("confidence").alias("confidence"))
        reached = reached.join(unknown.hint("merge"), "value").where(F.array_contains("fits", F.col("kind")))
        best = reached.groupBy("value").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("less"))).alias("best"))
        now = materialize(best.select("value", (-F.col("best.less")).alias("kind"), F.col("best.confidence").alias("score")), "known")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("value", "kind", "score").cast("decimal(38,0)"))).first()
        if found is not None:
            discard(found)
        found = now
        if mark == before or not mark[0]:
            break
        before = mark
    return found


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, an array of ``(start, end)`` for each of KINDS and ``added``, an array of ``(start, kind, end)``; one row per row.

    The arrays of the kinds are the base: what their rules find from left to right and their checks let pass. ``added`` are
    the places, outside of the base, of the instances that patterns discovered, wherever these stand, and ``kind`` is the
    number of the kind. Places are code points, ends exclusive. Null texts count as empty: no places. Repeated rows are
    searched each, though an instance counts once in the scores however often it is repeated; an empty table gives no
    rows; other columns are not looked at.
    """
    text = F.coalesce(T.column(text_col).cast("string"), F.lit(""))
    texts = docs.select(T.column(id_col).alias("id"), text.alias("text"))
    found = materialize(texts.select("id", *(_base(F.col("text"), kind).alias(kind) for kind in KINDS), _instances(F.col("text")).alias("instances")), "private")
    row = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    places = found.select(*row, "instances").select("file", "row", F.inline("instances"))
    patterns = F.array_compact(
        F.array(
            F.concat(F.lit("a "), F.col("l1")),
            F.concat(F.lit("b "), F.col("l2"), F.lit(" "), F.col("l1")),
            F.concat(F.lit("c "), F.col("l1"), F.lit(" _ "), F.col("r1")),
        )
    )
    edges = materialize(places.select("value", F.explode(patterns).alias("pattern")).distinct(), "edges")
    values = places.select("value").distinct()
    values = materialize(values.select("value", _seed(F.col("value")).alias("seed"), _fits(F.col("value")).alias("fits")), "values")
    known = discover(edges, values)
    hits = places.select("file", "row", "start", "end", "value").join(known.select("value", "kind"), "value")
    hits = hits.groupBy("file", "row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("hits"))
    both = found.select(*row, "id", *KINDS).join(hits.hint("merge"), ["file", "row"], "left")
    apart = lambda h: ~F.exists(F.concat(*KINDS), lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"]))
    added = F.coalesce(F.filter("hits", apart), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return both.select("id", *KINDS, added.alias("added"))


def op11_contextual_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = find_private(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def numbered(number: int, kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))

    base = [numbered(k, kind) for k, kind in enumerate(KINDS)]
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(shown(F.concat(*base)), 256).alias("base_sha256"),
        shown(F.concat(*base, F.col("added"))).alias("spans"),
    )


def _sql() -> str:
    """The same in SQL: rules without the marks that only keep the search linear, the rounds written out."""
    plain = {
        "email": rf"[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": BASE["phone"],
        "instance": rf"[^{_SPACE}0-9@]*[0-9@][^{_SPACE}]*(?: \(?[0-9][0-9().-]*)*",
    }
    digits = "regexp_replace({v}, '[^0-9]', '', 'g')"
    twice = "list_transform(reverse({d}).split(''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INTEGER ELSE (c::INTEGER * 2) // 10 + (c::INTEGER * 2) % 10 END)"
    luhn = f"list_sum({twice.format(d=digits)}) % 10 = 0"
    holds = {
        "email": "true",
        "ip": f"regexp_matches({{v}}, '{_IP_PARTS.replace('{', '{{').replace('}', '}}')}')",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }
    parts = ["WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"]
    for kind, rule in plain.items():
        parts.append(
            f"{kind}_m AS (SELECT r, regexp_extract_all(text, '{rule}') AS hits, regexp_split_to_array(text, '{rule}') AS gaps FROM t),\n"
            f"{kind}_p AS (SELECT r, i, hits[i] AS v, gaps[i] AS gap, gaps[i + 1] AS gap2,\n"
            "  list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS s\n"
            f"  FROM (SELECT *, unnest(range(1, length(hits) + 1))::INTEGER AS i FROM {kind}_m))"
        )
    spans = [f"SELECT r, s, {k} AS k, s + length(v) AS e FROM {kind}_p WHERE {holds[kind].format(v='v')}" for k, kind in enumerate(KINDS)]
    parts.append("base AS MATERIALIZED (" + " UNION ALL ".join(spans) + ")")
    low = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"list_filter(regexp_split_to_array({low}, '[{_SPACE}]+'), lambda w: w <> '')"
    parts.append(
        f"o AS MATERIALIZED (SELECT r, v, s, s + length(v) AS e, w[-2] AS l2, w[-1] AS l1, w2[1] AS r1 FROM (SELECT r, regexp_extract(v, '{_TRIMMED}', 1) AS v, s + length(regexp_extract(v, '{_LEAD}')) AS s,\n"
        f"  {words.format(x=f'right(gap, {CONTEXT})')} AS w, {words.format(x=f'left(gap2, {CONTEXT})')} AS w2 FROM instance_p)\n"
        f"  WHERE length(v) BETWEEN {SHORTEST} AND {LONGEST})"
    )
    parts.append("g AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT v, unnest(['a ' || l1, 'b ' || l2 || ' ' || l1, 'c ' || l1 || ' _ ' || r1]) AS p FROM o) WHERE p IS NOT NULL)")
    seed = " ".join(f"WHEN len(list_filter(regexp_extract_all(v, '{plain[kind]}'), lambda h: {holds[kind].format(v='h')})) > 0 THEN {k}" for k, kind in enumerate(KINDS))
    n = f"length({digits.format(v='v')})"
    numeric = "NOT regexp_matches(regexp_replace(v, '[ ().+-]', '', 'g'), '[^0-9]')"
    fits = ["contains(v, '@')", f"{n} >= 4 AND regexp_matches(v, '[.:]') AND NOT contains(v, '@')", f"{numeric} AND {n} BETWEEN 12 AND 19", f"{numeric} AND {n} BETWEEN 7 AND 15"]
    parts.append(f"x AS MATERIALIZED (SELECT v, CASE {seed} END AS seed, [{', '.join(fits)}] AS fits FROM (SELECT DISTINCT v FROM o))")
    parts.append("n AS MATERIALIZED (SELECT p, count(*) AS n FROM g GROUP BY ALL), k0 AS (SELECT v, 0 AS k, 0 AS score FROM x WHERE false)")
    for i in range(ROUNDS):
        parts.append(
            f"t{i} AS (SELECT p, k, sum(score) // (any_value(n) + 1) AS c FROM g JOIN (SELECT v, seed AS k, 1000 AS score FROM x WHERE seed IS NOT NULL UNION ALL FROM k{i}) USING (v)\n"
            f"  JOIN n USING (p) GROUP BY p, k HAVING c >= {LEAST}),\n"
            f"k{i + 1} AS MATERIALIZED (SELECT v, -max({{'c': c, 'k': -k}}).k AS k, max(c) AS score FROM g JOIN t{i} USING (p) JOIN x USING (v) WHERE seed IS NULL AND fits[k + 1] GROUP BY v)"
        )
    parts.append(
        f"a AS (SELECT r, s, k, e FROM base UNION ALL SELECT r, s, k, e FROM o JOIN k{ROUNDS} USING (v)\n"
        "  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = o.r AND b.s < o.e AND o.s < b.e))"
    )
    name = "CASE k WHEN 0 THEN 'email' WHEN 1 THEN 'ip' WHEN 2 THEN 'card' ELSE 'phone' END || ':' || s || ':' || e"
    listed = f"coalesce(string_agg({name}, ',' ORDER BY s, k, e), '')"
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, kind in enumerate(KINDS))
    return ",\n".join(parts) + (
        f"\nSELECT doc_id, n_email, n_ip, n_card, n_phone, sha256(shown) AS base_sha256, spans FROM t\n"
        f"JOIN (SELECT t.r, {counts}, {listed} AS shown FROM t LEFT JOIN base USING (r) GROUP BY t.r) USING (r)\n"
        f"JOIN (SELECT t.r, {listed} AS spans FROM t LEFT JOIN a USING (r) GROUP BY t.r) USING (r)"
    )


OP11_SQL = _sql()
