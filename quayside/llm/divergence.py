"""Source divergence audit: how far the word use of a language's sources lies apart.

A text's bytes go through one translation table, which lowers A-Z and blanks everything between terms, are split at the
blanks and counted per document. Each task merges the counts of its documents by (language, source) before anything is
shuffled, and Spark sums the sparse counts. A source's share of a term is a whole number of billionths, smoothed by
PRIOR, so all sums are exact. Sources are compared in blocks of terms: a block is a small dense matrix, terms by sources,
whose column differences are summed at once, so what leaves a task is one row per pair of sources, never one per pair and
term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.scratch import discard, materialize
from quayside.llm import tokens as T

PRIOR = 5  # added to every count
LEAST_DOCS = 30  # documents of a language in which a kept term stands
TOP_TERMS = 50
HELD_TERMS = 200_000  # distinct (group, term) that a task holds before it hands them on
PIECE_BYTES = 4 << 20  # bytes of a text that are split at once
BLOCK_CELLS = 1 << 16, 1 << 22  # terms times sources of a block: as many as pairs of sources, within these bounds

#: a-z and what is not ASCII stay, A-Z are lowered, the rest is blank: terms are ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def frequencies(raw: bytes, piece: int = PIECE_BYTES) -> Counter:
    """Term counts of one whole text. A long text is split piece by piece, each ending between terms."""
    clean, at, out = raw.translate(TABLE), 0, Counter()
    while at < len(clean):
        end = clean.find(b" ", at + piece)
        end = len(clean) if end < 0 else end
        out.update(clean[at:end].split())
        at = end
    return out


_COUNTS = "lang string, source string, term string, n long, docs long"


def count_terms(rows: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: places and documents of each term in each group, summed; and a row without a term
    for each group that occurs. ``rows``: lang, source and text without nulls."""

    def told(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]
            for a in range(0, len(terms), 50_000):
                part = terms[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()),
                        pa.array([source] * len(part), pa.string()),
                        pa.array([t and t.decode() for t in part], pa.string()),
                        pa.array([n.get(t, 0) for t in part], pa.int64()),
                        pa.array([docs.get(t, 0) for t in part], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            texts = batch.column(2)
            for k, group in enumerate(groups):
                n, docs = held.setdefault(group, (Counter(), Counter()))
                before = len(n)
                own = frequencies(texts[k].as_py().encode())
                n.update(own)
                docs.update(own.keys())
                size += len(n) - before
                if size >= HELD_TERMS:
                    yield from told(held)
                    held, size = {}, 0
        yield from told(held)

    T.bound_batches(rows.sparkSession)
    parts = rows.select("lang", "source", "text").mapInArrow(run, _COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, kept: str) -> F.Column:
    """1 + floor(10^9 (n + PRIOR) / (total + PRIOR kept)), in decimals, so no count overflows."""
    above = f"cast({n} + {PRIOR} AS decimal(20,0)) * cast(1000000000 AS decimal(10,0))"
    return F.expr(f"1 + ({above}) div cast({total} + {PRIOR} * {kept} AS decimal(20,0))")


def _block_sums(key: tuple, cells: pa.Table, bases: pa.Table) -> pa.Table:
    """Sums over a block's terms of the differences of each source to each other one."""
    names = bases.column("source").combine_chunks()
    base = bases.column("base").fill_null(0).to_numpy()
    terms = cells.column("term").combine_chunks().dictionary_encode()
    row = terms.indices.to_numpy()
    column = pa.compute.index_in(cells.column("source").combine_chunks(), value_set=names).to_numpy()
    share = np.repeat(base[None, :], len(terms.dictionary), 0)
    share[row, column] = cells.column("p").to_numpy()
    size = len(names)
    sums = np.concatenate([np.abs(share - share[:, i : i + 1]).sum(0) for i in range(size)]) if size else np.zeros(0, np.int64)
    one, other = np.repeat(np.arange(size), size), np.tile(np.arange(size), size)
    apart = one != other
    return pa.table(
        {
            "lang": pa.array([key[0].as_py()] * int(apart.sum()), pa.string()),
            "source": names.take(pa.array(one[apart])),
            "item": names.take(pa.array(other[apart])),
            "value": pa.array(sums[apart], pa.int64()),
        }
    )


def audit_sources(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (language, source) group that occurs.

    A language keeps the terms that stand in at least ``least_docs`` of its documents; p is a group's smoothed share of a
    kept term in billionths, q another's. Part ``pair``: for each other source of the language (``item``) the sum of
    abs(p - q) over all kept terms, all ranks. Part ``term``: the ``top`` kept terms (``item``) that the group has and
    whose p is above the share in the whole language, by p - q. Ranks go by value, descending, then by the item's bytes.

    Null texts, languages and sources count as empty ones, so '' may be a language or a source; repeated rows count each;
    an empty table gives no rows; a language without kept terms has pairs of value 0 and no terms; a language of one
    source has no pairs. Other columns are not looked at. The work and the result of part ``pair`` grow with the square
    of a language's sources, as all of them are asked for.
    """
    rows = docs.select(*(F.coalesce(T.column(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = materialize(count_terms(rows), "counts")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
    kept = materialize(terms.where(F.col("docs") >= least_docs).select("lang", "term", "all_n"), "kept")
    cells = materialize(counts.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "cells")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("lang_total"))
    of_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "lang_total")))
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = groups.join(sources, "lang").withColumn("base", F.when(F.col("kept") > 0, _share("0", "total", "kept")))
    size = F.greatest(F.lit(BLOCK_CELLS[0]), F.least(F.lit(BLOCK_CELLS[1]), F.col("sources") * F.col("sources")))
    groups = materialize(groups.withColumn("blocks", F.ceil(F.greatest(F.lit(1), F.col("kept") * F.col("sources") / size)).cast("long")), "groups")
    discard(counts)

    shares = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "total", "kept").alias("p"), _share("all_n", "lang_total", "kept").alias("q"), F.expr("pmod(xxhash64(term), blocks)").alias("block")
    )
    bases = groups.select("lang", "source", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    left, right = shares.select("lang", "block", "source", "term", "p").groupBy("lang", "block"), bases.groupBy("lang", "block")
    pairs = left.cogroup(right).applyInArrow(_block_sums, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shape(pairs, "pair").unionByName(shape(above, "term"))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Sources of all documents."""
    return audit_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\x{0}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0) AS total
  FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source LEFT JOIN k ON c.lang = k.lang AND c.term = k.term GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.total + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM s JOIN l ON s.lang = l.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r
QUALIFY part = 'pair' OR rank <= 50
"""
