"""N-gram Jaccard join: every pair of texts whose sets of n-word shingles are alike enough, found without comparing all.

Method
1. A text becomes the set of 64-bit hashes of its n-word shingles (whole text; fewer words: the whole sequence). Equal
   sets share a 128-bit digest; each distinct set is a *node* and counts once from here on.
2. Rare-first order. A fixed fraction of the hash space, wider than any prefix needs, holds the *counted* shingles; they
   come first, ordered by the number of nodes that hold them (an exact count over all nodes), then by hash. The rest comes
   after, ordered by hash. This is one order for all nodes, which is all that prefix filtering needs, and only a fraction
   of the shingles is shuffled. A set too small to fill its prefix from the counted ones goes on with the others.
3. Prefix filter: two sets of a similarity of ``num/den`` at least share a shingle among the first
   ``size - ceil(size * num / den) + 1`` of each. Shingles that one node alone holds fill prefix places but find nothing,
   so most nodes leave here.
4. The nodes that stay go through 2 and 3 again among themselves, now with all their shingles counted, which makes the
   positional filter sharp.
5. Candidates share a prefix shingle and pass the length and the positional filter. First each node meets the hub of each
   of its prefix shingles' lists, the one with the fewest rare shingles before it: as many pairs as there are list
   entries. Of thousands of near copies of one text, most link to such a hub at once.
6. The pairs whose ends are then in different components are all looked at, so no link that would join two components is
   lost. A bound of the symmetric difference (parities of hashed places, as an odd sketch: they differ in no more places
   than the sets) is part of the join's condition, so that pairs of copies that were edited too much to link are not made.
7. A candidate is verified once: the suffix filter bounds the overlap by halving both sets at a pivot, then the sets are
   intersected exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.graph import connected_components
from quayside.functions.scratch import discard, materialize
from quayside.llm import tokens as T

_WORDS = {"space": T.space_words, "alnum": T.alnum_words}
_ODD_WORDS = 16  # 1024 parities a set
_FILTER_BITS = 27  # at most, of the bitmap that spares most other sets the shuffle before step 4 (16 MB)


def _needed(size: np.ndarray | int, num: int, den: int):
    """Smallest overlap of a set of this size with any set alike enough."""
    return -(-size * num // den)


def _batches(batches: Iterator[pa.RecordBatch], n: int, words: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        text = T.filled(batch.column(batch.num_columns - 1))
        for a, b in T.slices(text):
            yield batch.slice(a, b - a), T.shingle_sets(_WORDS[words](*T.utf8(text.slice(a, b - a))), n)


def _digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def _signatures(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int, words: str) -> DataFrame:
    share = min(1.0, 1.15 * (1 - num / den) + 0.01)
    border = np.uint64(int(share * 2**64) - 1 if share < 1 else 2**64 - 1)

    T.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _batches(batches, n, words):
            counted, others = [], []
            for s in sets:
                k = int(np.searchsorted(s, border, side="right"))
                prefix = len(s) - _needed(len(s), num, den) + 1 if len(s) else 0
                counted.append(s[:k])
                others.append(s[k : max(prefix, k)])
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            digest = np.frombuffer(b"".join(map(_digest, sets)), np.int64).reshape(-1, 2)
            columns = [rows.column(0), pa.array(size), pa.array(digest[:, 0]), pa.array(digest[:, 1]), T.list_column(counted, pa.int64()), T.list_column(others, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "hi", "lo", "counted", "others"])

    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(T.column(id_col).alias("id"), T.column(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {id_type}, size long, hi long, lo long, counted array<long>, others array<long>")


def _prefixes(postings: DataFrame, num: int, den: int) -> DataFrame:
    """``(node, size, key, pos)``: the shared shingles of each node's prefix and their places in its order.

    ``postings``: ``(node, size, key)``, ordered by the number of nodes, or ``(node, size, n_counted, i, key)``, of which the
    first ``n_counted`` of a node are, and the others by ``i``.
    """
    shared = postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    mine = postings.join(shared.hint("shuffle_merge"), "key")
    prefix = F.expr(f"size - cast(ceil(size * {num}L / {den}) as bigint) + 1")
    place = lambda alone: F.transform("first", lambda x, i: F.struct((alone + i).cast("long").alias("pos"), x["key"].alias("key")))
    if "i" not in postings.columns:
        places = mine.groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("first"))
        at = place(F.col("size") - F.size("first"))
    else:
        places = mine.groupBy("node", "size", "n_counted").agg(
            F.array_sort(F.collect_list(F.when(F.col("i") < F.col("n_counted"), F.struct("df", "key")))).alias("first"),
            F.collect_list(F.when(F.col("i") >= F.col("n_counted"), F.struct("i", "key"))).alias("later"),
        )
        at = F.concat(place(F.col("n_counted") - F.size("first")), F.transform("later", lambda x: F.struct(x["i"].cast("long").alias("pos"), x["key"].alias("key"))))
    located = places.select("node", "size", prefix.alias("prefix"), at.alias("at"))
    return located.select("node", "size", "prefix", F.inline("at")).where("pos < prefix").drop("prefix")


def _met(prefixes: DataFrame) -> DataFrame:
    """The entries whose shingle stands in the prefix of another node too."""
    shared = prefixes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return prefixes.join(shared.hint("shuffle_merge"), "key", "left_semi")


def _filtered(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Length and positional filter, then each pair once. ``a`` is the smaller (size, node)."""
    overlap = f"cast(ceil((size_a + size_b) * {num}L / {num + den}) as bigint)"
    ok = pairs.where(f"size_a * {den}L >= size_b * {num}L").where(f"least(size_a - pos_a, size_b - pos_b) + least(pos_a, pos_b) >= {overlap}")
    return ok.groupBy("a", "b").agg(F.count("*").alias("hits")).drop("hits")


def _odd(s: np.ndarray) -> np.ndarray:
    """Parity of the number of elements at each of 64 * _ODD_WORDS hashed places."""
    at = (T.mix(s) & np.uint64(64 * _ODD_WORDS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * _ODD_WORDS) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _rename(df: DataFrame, side: str) -> DataFrame:
    return df.select("key", *[F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in df.columns if c != "key"])


def _star_pairs(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """Each node with the hubs of its shingles' lists."""
    hubs = prefixes.groupBy("key").agg(F.min(F.struct("pos", "size", "node")).alias("hub"))
    hubs = hubs.select("key", F.col("hub.node").alias("h"), F.col("hub.size").alias("size_h"), F.col("hub.pos").alias("pos_h"))
    met = prefixes.join(hubs.hint("shuffle_merge"), "key").where("node <> h")
    first = "(size_h < size or size_h = size and h < node)"
    pick = lambda x, y, c: F.expr(f"case when {first} then {x} else {y} end").alias(c)
    return _filtered(met.select(pick("h", "node", "a"), pick("node", "h", "b"), pick("size_h", "size", "size_a"), pick("size", "size_h", "size_b"), pick("pos_h", "pos", "pos_a"), pick("pos", "pos_h", "pos_b")), num, den)


def _mixed(prefixes: DataFrame, comps: DataFrame) -> DataFrame:
    """Entries of shingles whose lists hold nodes of different components, with the components."""
    known = prefixes.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    keys = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return known.join(keys.hint("shuffle_merge"), "key", "left_semi")


def _cross_pairs(mixed: DataFrame, done: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that share a prefix shingle and whose ends lie in different components so far."""
    pairs = _rename(mixed, "a").join(_rename(mixed, "b").hint("shuffle_merge"), "key").where("comp_a <> comp_b and (size_a < size_b or size_a = size_b and a < b)")
    apart = " + ".join(f"bit_count(odd_a[{k}] ^ odd_b[{k}])" for k in range(_ODD_WORDS))
    pairs = pairs.where(f"{apart} <= size_a + size_b - 2 * cast(ceil((size_a + size_b) * {num}L / {num + den}) as bigint)")
    return _filtered(pairs, num, den).join(done.select("a", "b"), ["a", "b"], "left_anti")


def _overlap_bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """Suffix filter: an upper bound of the overlap of two sorted sets, by halving both at the middle of ``y``."""
    if not len(x) or not len(y) or not depth:
        return min(len(x), len(y))
    m = len(y) // 2
    k = int(np.searchsorted(x, y[m]))
    same = int(k < len(x) and x[k] == y[m])
    return _overlap_bound(x[:k], y[:m], depth - 1) + same + _overlap_bound(x[k + same :], y[m + 1 :], depth - 1)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs with their exact overlap, and whether they are alike enough."""

    T.bound_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x"), batch.column("y")
            xo, yo, xv, yv = xs.offsets.to_numpy(), ys.offsets.to_numpy(), xs.values.to_numpy(), ys.values.to_numpy()
            shared = np.zeros(batch.num_rows, np.int64)
            link = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                least = -(-(len(x) + len(y)) * num // (num + den))
                if _overlap_bound(x, y, 3) >= least:
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    shared[i] = int((x[at] == y).sum())
                    link[i] = shared[i] * den >= (len(x) + len(y) - shared[i]) * num
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared), pa.array(link)], names=["a", "b", "overlap", "link"])

    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.select("a", "b").join(x.hint("shuffle_merge"), "a").join(y.hint("shuffle_merge"), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, overlap long, link boolean")


def _wanted_sets(docs: DataFrame, text_col: str, wanted: DataFrame, n: int, words: str) -> DataFrame:
    """``(node, size, shingles, odd)`` of the nodes of ``wanted`` (node, hi, lo), the sets being made from the texts again.

    A bitmap of eight bits a node, but 2 ** _FILTER_BITS at most, holds most other sets back before the shuffle. With far
    more nodes than bits it holds back less, and the shuffle grows to that of all sets; the join after it is exact.
    """
    bits = min(_FILTER_BITS, max(16, (8 * wanted.count()).bit_length()))
    slot = F.col("hi").bitwiseAND((1 << bits) - 1)
    found = wanted.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[found["w"].to_numpy()] = found["bits"].to_numpy()
    seen = wanted.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    T.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _batches(batches, n, words):
            sets = [s for s in sets if len(s)]
            digest = np.frombuffer(b"".join(map(_digest, sets)), np.int64).reshape(-1, 2)
            at = digest[:, 0].view(np.uint64) if len(sets) else np.zeros(0, np.uint64)
            at = at & np.uint64((1 << bits) - 1)
            held = ((seen.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
            kept = [s for s, k in zip(sets, held) if k]
            columns = [pa.array(digest[held, 0]), pa.array(digest[held, 1]), T.list_column([np.sort(s.view(np.int64)) for s in kept], pa.int64()), T.list_column([_odd(s) for s in kept], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "shingles", "odd"])

    made = docs.select(T.column(text_col).cast("string").alias("text")).mapInArrow(run, "hi long, lo long, shingles array<long>, odd array<long>")
    # Equal sets come once per copy: keep one, by the partial aggregation's first.
    once = made.groupBy("hi", "lo").agg(F.first("shingles").alias("shingles"), F.first("odd").alias("odd"))
    return once.join(wanted.hint("shuffle_merge"), ["hi", "lo"]).select("node", F.size("shingles").cast("long").alias("size"), "shingles", "odd")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, num: int = 4, den: int = 5, words: str = "space") -> dict[str, DataFrame]:
    """All links between texts whose shingle sets have a Jaccard similarity of ``num / den`` or more, as components.

    Returns ``members``: one row per input row with ``id``, ``size`` (of its set), ``node`` (number of its set; null for
    no words) and ``component`` (smallest id that links reach, its own included); and ``links``: the verified pairs
    ``(a, b, overlap)`` of nodes that connect the components.

    Null or empty texts and texts without words have an empty set and link with nothing. Equal sets always link.
    Repeated ids are separate rows; ids may be null, and a component of null ids alone is null. An empty table gives
    empty results. Other columns of ``docs`` are not looked at.
    """
    sig = materialize(_signatures(docs, id_col, text_col, n, num, den, words), "signatures")
    alike = sig.where("size > 0").groupBy("hi", "lo").agg(F.min("id").alias("least"), F.first("size").alias("size"), F.first("counted").alias("counted"), F.first("others").alias("others"))
    nodes = materialize(alike.withColumn("node", F.monotonically_increasing_id()), "nodes")
    slim = materialize(sig.select("id", "size", "hi", "lo"), "signatures")
    discard(sig)
    part = nodes.select("node", "size", F.size("counted").alias("n_counted"), F.posexplode(F.concat("counted", "others")).alias("i", "key"))
    coarse = materialize(_prefixes(part, num, den), "prefixes")
    wanted = materialize(nodes.select("node", "hi", "lo").join(_met(coarse).select("node").distinct().hint("shuffle_merge"), "node", "left_semi"), "wanted")
    lists, nodes = nodes, materialize(nodes.select("node", "hi", "lo", "least"), "nodes")
    discard(coarse, lists)
    sets = materialize(_wanted_sets(docs, text_col, wanted, n, words), "sets", compression="lz4")
    fine = materialize(_prefixes(sets.select("node", "size", F.explode("shingles").alias("key")), num, den), "prefixes")
    met = materialize(_met(fine), "met")
    discard(wanted, fine)
    done = materialize(_verified(_star_pairs(met, num, den), sets, num, den), "verified")
    comps = materialize(connected_components(done.where("link"), "a", "b"), "components")
    mixed = materialize(_mixed(met, comps).join(sets.select("node", "odd").hint("shuffle_merge"), "node"), "mixed")
    discard(met, comps)
    done = done.unionByName(materialize(_verified(_cross_pairs(mixed, done, num, den), sets, num, den), "verified"))
    discard(mixed, sets)
    links = done.where("link").drop("link")
    comps = connected_components(links, "a", "b")
    rooted = nodes.select("node", "hi", "lo", "least").join(comps, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    roots = rooted.groupBy("root").agg(F.min("least").alias("component"))
    labels = rooted.select("node", "hi", "lo", "root").join(roots.hint("shuffle_merge"), "root").select("node", "hi", "lo", "component")
    members = slim.where("size > 0").join(labels.hint("shuffle_merge"), ["hi", "lo"]).select("id", "size", "node", "component")
    alone = slim.where("size = 0").select("id", "size", F.lit(None).cast("long").alias("node"), F.col("id").alias("component"))
    return {"members": members.unionByName(alone), "links": links}


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; of rows that share it, one.

    A row with a null id stays if it belongs to no component with another row. Columns keep their names, whatever they are.
    """
    row = T.unused_name("_row", docs.columns)
    marked = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    members = jaccard_join(marked.select(T.column(text_col), row), row, text_col, **how)["members"]
    ids = marked.select(F.col(row).alias("id"), T.column(id_col).alias("doc"))
    kept = members.join(ids, "id").groupBy("component").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "id")).alias("k")).select(F.col("k.id").alias(row))
    return marked.join(kept.hint("shuffle_merge"), row, "left_semi").select(*map(T.column, docs.columns))


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at four-word shingles and a similarity of 0.85."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = jaccard_join(docs, n=4, num=85, den=100)["members"]
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_aggregate(ws[i:i + 3], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN c ca ON ca.doc_id = a.doc_id JOIN c cb ON cb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, ca.n, cb.n HAVING 100 * count(*) >= 85 * (ca.n + cb.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT d.doc_id, coalesce(any_value(c.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""
