"""Spelling variants: words one edit apart, found by walking a trie of all words as a relation.

The trie is an edge table: a node is a prefix (by 64-bit hash), and an edge row holds the node, its letter, the letter
after that and the prefix that both lead to. A state is (word, place of the edit, its letter, position); its node follows
from these. Words stand in the trie forwards and backwards, each closed by END. An edit in a word's second half is made
in the forward trie, one in the first half in the backward trie, so both tries are entered below their crowded top, at
the node of the word's own half, and each pair of words is met once.

Replacements branch to the other children of a node that have the word's next letter as a child; deletions stay at the
node; an insertion is the deletion of the longer word. From there states follow their word's letters, two edges a level,
joined with the edge table level by level, until those that reach END become neighbours and the others have died. What
reaches END is joined with the words as strings, so a collision of hashes makes no neighbours. The few words of more than
MOST_LETTERS letters, whose tries would be deep, are compared by the hashes of their one-letter deletions instead, which
is exact as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.scratch import discard, materialize
from quayside.llm import tokens as T

LEAST_LETTERS = 7
LEAST_PLACES = 2
FORM_FACTOR = 10
MOST_LETTERS = 40  # of words in the trie
END = "|"
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_one_in: int = 31) -> DataFrame:
    """``(word, n)``: words of at least LEAST_LETTERS letters and LEAST_PLACES places in all texts.

    Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lowered. Of a run whose h, the CRC-32 of ``<id>:<run>``, is
    a multiple of ``drop_one_in``, letter number h modulo its length is left out (a made misspelling). Null texts have no
    words, a null id counts as an empty one.
    """
    low = F.translate(T.column(text_col).cast("string"), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(T.column(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(r"[a-zA-ZÀ-ÿ]+"), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_LETTERS).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    cut = F.expr("concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2))")
    words = runs.select(F.when(F.col("h") % drop_one_in == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PLACES)


def _both_ways(words: DataFrame) -> DataFrame:
    """``side`` (0 forwards, 1 backwards), ``s`` (the word that way, then END) and ``size`` (letters of the word)."""
    ways = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("s")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s")))
    return words.select(F.inline(ways)).select("side", F.concat("s", F.lit(END)).alias("s"), F.length("s").alias("size"))


def trie_edges(words: DataFrame) -> DataFrame:
    """``(node, letter, after, path)`` of both tries, below their first three letters."""
    steps = _both_ways(words).select("side", "s", F.explode(F.sequence(F.lit(3), F.col("size") - 1)).alias("at"))
    return steps.selectExpr(
        "xxhash64(side, substring(s, 1, at)) AS node", "substring(s, at + 1, 1) AS letter", "substring(s, at + 2, 1) AS after", "xxhash64(side, substring(s, 1, at + 2)) AS path"
    ).distinct()


_STATE = ["side", "s", "size", "at", "letter", "pos"]
#: The prefix at which a state stands once ``pos`` letters of its word are used up.
_REACHED = "concat(substring(s, 1, at), letter, substring(s, at + 2, {pos} - at - 1))"


def trie_neighbours(words: DataFrame) -> DataFrame:
    """``(word, other)``, each pair of words one edit apart once; words of at most MOST_LETTERS letters."""
    edges = materialize(trie_edges(words), "edges")
    half = "size div 2"
    first = F.expr(f"CASE side WHEN 0 THEN {half} ELSE size - {half} END")
    own = _both_ways(words).select("*", F.explode(F.sequence(first, F.col("size") - 1)).alias("at"))

    branch = own.selectExpr("*", "substring(s, at + 1, 1) AS here", "substring(s, at + 2, 1) AS after", "xxhash64(side, substring(s, 1, at)) AS node")
    replaced = branch.join(edges.select("node", "letter", "after").hint("merge"), ["node", "after"]).where(F.col("letter") > F.col("here"))
    replaced = replaced.withColumn("pos", F.col("at") + 2).select(*_STATE)
    # Of equal letters that follow each other, the first one of the word is the one to delete.
    before = F.expr("substring(s, CASE side WHEN 0 THEN at ELSE at + 2 END, 1)")
    deleted = own.where((F.col("size") > LEAST_LETTERS) & (F.expr("substring(s, at + 1, 1)") != before))
    deleted = deleted.selectExpr("side", "s", "size", "at", "'' AS letter", "at + 1 AS pos")

    level = materialize(replaced, "states")
    levels, walking = [level], level.where("pos <= size").unionByName(deleted)
    while True:
        onward = walking.withColumn("pos", F.least(F.col("pos") + 2, F.col("size") + 1))
        onward = onward.withColumn("path", F.xxhash64("side", F.expr(_REACHED.format(pos="pos"))))
        level = materialize(onward.join(edges.select("path").hint("merge"), "path", "left_semi").select(*_STATE), "states")
        levels.append(level)
        walking = level.where("pos <= size")
        if walking.isEmpty():
            break
    discard(edges)
    ended = levels[0]
    for level in levels[1:]:
        ended = ended.unionByName(level)
    ended = ended.where("pos > size").selectExpr("side", "substring(s, 1, size) AS word", "concat(substring(s, 1, at), letter, substring(s, at + 2, size - at - 1)) AS other")
    turned = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c)).alias(c)
    return ended.select(turned("word"), turned("other"))


_VARIANT = "id long, size long, at long, variant long"


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word its own hash (``at`` -1) and the hash of the word without each of its letters."""
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    for batch in batches:
        for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
            powers = np.full(len(letters), _BASE, np.uint64)
            powers[0] = 1
            powers = powers.cumprod()
            sums = np.concatenate((np.zeros(1, np.uint64), (letters * powers).cumsum()))
            found = np.concatenate((sums[-1:], sums[:-1] + (sums[-1] - sums[1:]) * inverse)).view(np.int64)
            for a in range(0, len(found), 50_000):
                n = len(found[a : a + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), pa.array(np.full(n, len(letters))), pa.array(np.arange(a, a + n) - 1), pa.array(found[a : a + n])], names=["id", "size", "at", "variant"]
                )


def long_neighbours(words: DataFrame) -> DataFrame:
    """``(word, other)`` of long words one edit apart, each pair once, by the hashes of their one-letter deletions."""
    named = words.select(F.xxhash64("word").alias("id"), "word")
    found = materialize(named.mapInArrow(_variants, _VARIANT), "variants")
    one, other = found.where("at >= 0"), found.select(F.col("id").alias("other"), F.col("size").alias("o_size"), F.col("at").alias("o_at"), "variant")
    replaced = one.join(other, "variant").where("at = o_at and size = o_size and id < other")
    deleted = one.join(other.where("o_at = -1"), "variant").where("o_size = size - 1")
    pairs = replaced.select("id", "other").unionByName(deleted.select("id", "other")).distinct()
    texts = pairs.join(named, "id").join(named.select(F.col("id").alias("other"), F.col("word").alias("o_word")), "other")
    return texts.select("word", F.col("o_word").alias("other")).where(F.levenshtein("word", "other", 1) == 1)


def group_spellings(words: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for a table of distinct words of LEAST_LETTERS letters or more with counts.

    ``n_near``: words that differ by exactly one inserted, deleted or replaced letter; ``form``: of these the one of largest
    n (ties: the smallest by code points), if its n is at least FORM_FACTOR times the word's, else null; ``root``: the end
    of the chain of forms, the word itself without one. An empty table gives no rows; other columns are not looked at.
    """
    words = words.select("word", "n")
    pairs = trie_neighbours(words.where(F.length("word") <= MOST_LETTERS))
    long = words.where(F.length("word") >= MOST_LETTERS)
    if not long.isEmpty():
        pairs = pairs.unionByName(long_neighbours(long).where(F.greatest(F.length("word"), F.length("other")) > MOST_LETTERS))
    n_of = lambda name, n: words.select(F.col("word").alias(name), F.col("n").alias(n)).hint("merge")
    pairs = materialize(pairs.join(n_of("other", "o_n"), "other").join(n_of("word", "n"), "word"), "pairs")
    ends = pairs.select("word", "other", "o_n").unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("o_n")))
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("o_n")).alias("less"), "other")).alias("best"))
    near = words.join(best.hint("merge"), "word", "left")
    is_form = -F.col("best.less") >= FORM_FACTOR * F.col("n")
    near = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")
    )
    near = materialize(near, "near")
    # A form has ten times the places, so a chain has some twenty words at most, and its reach doubles each time.
    links = near.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = materialize(links.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(links)
        links = step
        if step.where("moved").isEmpty():
            break
    roots = links.select("word", "root")
    return near.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Words of all documents."""
    words = materialize(count_words(spark.read.parquet(f"{sf_dir}/documents.parquet")), "words")
    return group_spellings(words).select("word", "n", "n_near", "form", "form_n", "root")


def _crc_table() -> list[int]:
    """The table of the reflected CRC-32 with polynomial EDB88320, by its rule."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


OP12_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zA-Z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM d WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS bytes FROM c),
h AS (SELECT run, n, xor(4294967295, list_reduce(bytes, lambda a, x: xor(a >> 8, ({_crc_table()}::BIGINT[])[(xor(a, x) & 255) + 1]), 4294967295::BIGINT)) AS h FROM b),
r AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INTEGER) || substring(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM r WHERE length(word) >= 7 GROUP BY ALL HAVING sum(n) >= 2),
v AS MATERIALIZED (
  SELECT word, k, substring(word, 1, k - 1) || substring(word, k + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1))::INTEGER AS k FROM w)),
p AS (SELECT a.word, b.word AS other FROM v a JOIN v b ON a.less = b.less AND a.k = b.k AND a.word <> b.word
  UNION SELECT v.word, w.word FROM v JOIN w ON v.less = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.less = w.word),
m AS (SELECT p.word, count(*) AS n_near, min({{'a': -w.n, 'b': w.word}}) AS best FROM p JOIN w ON p.other = w.word GROUP BY ALL),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.a >= 10 * w.n THEN best.b END AS form, CASE WHEN -best.a >= 10 * w.n THEN -best.a END::BIGINT AS form_n
  FROM w LEFT JOIN m ON w.word = m.word),
t AS (SELECT word, coalesce(form, word) AS root, form IS NOT NULL AS more FROM f
  UNION ALL SELECT t.word, f.form, true FROM t JOIN f ON t.root = f.word WHERE more AND f.form IS NOT NULL),
e AS (SELECT t.word, t.root FROM t JOIN f ON t.root = f.word WHERE f.form IS NULL)
SELECT f.word, n, n_near, form, form_n, e.root FROM f JOIN e ON f.word = e.word
"""
