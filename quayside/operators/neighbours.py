"""Nearest neighbours: exact in blocks, approximate by signed random projections, exact within one table by cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.names import column
from quayside.functions.scratch import discard, materialize
from quayside.operators.joins import top_k_per_group


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    kind = "array<float>" if df.select(column(vector)).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    return df.select(column(key).alias("id"), column(vector).cast(kind).alias("v")).where("id is not null and v is not null and size(v) > 0")


def _unit(values: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in values])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _most_similar(some: pd.DataFrame, all_: pd.DataFrame, k: int) -> pd.DataFrame:
    """``(query, neighbour, similarity)`` of the k vectors of ``all_`` most similar to each of ``some`` (ties: the smaller key).

    A product of matrices finds the candidates: those that reach the k-th of about 2048 vectors of ``all_``. Their similarity
    is then added up number by number, so that copies of a vector tie wherever they stand.
    """
    made = [pd.DataFrame({"query": some["id"].to_numpy()[:0], "neighbour": all_["id"].to_numpy()[:0], "similarity": np.zeros(0)})]
    if some.empty or all_.empty:
        return made[0]
    all_ = all_.sort_values("id")
    ids, names = some["id"].to_numpy(), all_["id"].to_numpy()
    x, y, most = _unit(some["v"]), _unit(all_["v"]), min(k, len(names))
    across, apart = np.ascontiguousarray(y.T), max(1, min(len(names) // 2048, len(names) // most))
    for at in range(0, len(ids), 128):  # a slice of similarities at a time, so a task holds some MB of them
        own = ids[at : at + 128]
        sims = x[at : at + 128] @ across
        low, high = np.searchsorted(names, own, "left"), np.searchsorted(names, own, "right")
        for r in np.flatnonzero(high > low):
            sims[r, low[r] : high[r]] = -np.inf
        few = sims[:, ::apart]
        least = np.partition(few, few.shape[1] - most, axis=1)[:, few.shape[1] - most] - 1e-9
        row, col = np.divmod(np.flatnonzero((sims >= least[:, None]) & (sims > -np.inf)), len(names))
        score = np.concatenate([(x[at + row[c : c + 65536]] * y[col[c : c + 65536]]).sum(1) for c in range(0, max(1, len(row)), 65536)])
        order = np.lexsort((col, -score, row))
        row, col, score = row[order], col[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < most
        made.append(pd.DataFrame({"query": own[row[kept]], "neighbour": names[col[kept]], "similarity": score[kept]}))
    return pd.concat(made[1:])


def nearest_neighbours(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, block: int = 65536, vector_block: int = 32768) -> DataFrame:
    """``(query, neighbour, similarity, rank)``: the exact k nearest by cosine, the query itself left out.

    Queries and vectors are dealt into blocks of at most about these sizes. Each block of queries meets each block of vectors
    in a task of its own as one matrix product, which keeps its k best, and a window picks the k best of those (ties: the
    smaller key). Null and empty vectors and null keys are left out, a vector of length 0 has similarity 0 to all; all vectors
    must have as many numbers. Without queries or vectors there are no rows.
    """
    q, v = _vectors(queries, key, vector), _vectors(vectors, key, vector)
    kind = v.schema["id"].dataType.simpleString()
    sizes, tasks = [q.count(), v.count()], v.sparkSession.sparkContext.defaultParallelism
    n_v = max(1, -(-sizes[1] // vector_block), min(tasks, -(-sizes[1] // 1024)))
    n_q = max(1, -(-sizes[0] // block), min(-(-4 * tasks // n_v), -(-sizes[0] // 1024)))  # few blocks are worth all tasks as well
    deal = lambda own, n: F.pmod(F.xxhash64("id", F.lit(own)), F.lit(n)).cast("int").alias(own)
    every = lambda other, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(other)

    left = q.select("id", "v", deal("q", n_q), every("w", n_v)).groupBy("q", "w")
    right = v.select("id", "v", deal("w", n_v), every("q", n_q)).groupBy("q", "w")
    out = left.cogroup(right).applyInPandas(lambda some, all_: _most_similar(some, all_, k), f"query {kind}, neighbour {kind}, similarity double")
    return top_k_per_group(out, ["query"], [F.desc("similarity"), F.col("neighbour")], k, "rank")


def _codes(x: np.ndarray, planes: np.ndarray, probes: int) -> np.ndarray:
    """Of each row in each table its own bucket and the ``probes`` next likely ones, which differ from it in those signs whose
    projections lie nearest to 0. ``planes``: dimensions, tables, bits."""
    wide, tables, bits = planes.shape
    at = (x @ planes.reshape(wide, -1)).reshape(len(x), tables, bits)
    own = ((at > 0) << np.arange(bits)).sum(2)[..., None]
    if not probes:
        return own
    loose = min(bits, 6)
    subsets = (np.arange(1, 1 << loose)[:, None] >> np.arange(loose)) & 1
    order = np.argsort(np.abs(at), axis=2)[..., :loose]
    cost = np.take_along_axis(at, order, 2) ** 2 @ subsets.T
    taken = np.argsort(cost, axis=2)[..., :probes]
    flips = ((1 << order) @ subsets.T).astype(np.int64)
    return np.concatenate([own, own ^ np.take_along_axis(flips, taken, 2)], axis=2)


def _hashed(df: DataFrame, kind: str, planes: np.ndarray, probes: int, vectors: bool = True) -> DataFrame:
    """``(id, v, table, bucket)``: each vector in the buckets of ``_codes``, or without ``v``."""
    tables = planes.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in (whole.iloc[a : a + 1000] for a in range(0, len(whole), 1000)):
                codes = _codes(_unit(pdf["v"]), planes, probes)
                made = pdf.iloc[np.repeat(np.arange(len(pdf)), codes[0].size)][["id", "v"] if vectors else ["id"]]
                yield made.assign(table=np.tile(np.repeat(np.arange(tables), codes.shape[2]), len(pdf)), bucket=codes.reshape(-1))

    return df.mapInPandas(run, f"id {kind}, {f'v {df.schema["v"].dataType.simpleString()}, ' if vectors else ''}table int, bucket long")


def _fitted_bits(q: DataFrame, v: DataFrame, k: int, planes: np.ndarray, probes: int, recall: float, sample: int) -> int:
    """The most bits with which a sample of queries finds the share ``recall`` of its exact neighbours among all vectors."""
    some = materialize(q.orderBy(F.xxhash64("id"), "id").limit(sample), "sample")
    exact = nearest_neighbours(some, v, "id", "v", k).select("query", F.col("neighbour").alias("id"))
    ends = exact.join(v, "id").select("query", F.col("v").alias("w")).join(some.withColumnRenamed("id", "query"), "query").select("v", "w").toPandas()  # sample times k rows
    discard(some)
    if ends.empty:
        return planes.shape[2]
    x, y = _unit(ends["v"]), _unit(ends["w"])
    for bits in range(planes.shape[2], 1, -1):
        met = (_codes(x, planes[..., :bits], probes) == _codes(y, planes[..., :bits], 0)).any((1, 2))
        if met.mean() >= recall:
            return bits
    return 1


def lsh_neighbours(
    queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, tables: int = 12, probes: int = 12, bucket_rows: int = 64, crowded: int = 8192, seed: int = 1, recall: float = 0.95, sample: int = 100
) -> DataFrame:
    """``(query, neighbour, similarity, rank)``: about the k nearest by cosine, the query itself left out.

    Every vector stands in one bucket of each of ``tables`` tables: the signs of its random projections. There are at most so
    many bits that an even deal would put ``bucket_rows`` vectors into a bucket, and fewer where a ``sample`` of the queries
    (those of the smallest hashes) would find less than the share ``recall`` of its exact neighbours: as a table grows, its
    buckets do. A query looks into its own bucket of a table and the ``probes`` likeliest beside it. All vectors met are
    candidates, however many, and their similarity is exact; a bucket meets its queries as one product of matrices, of which
    each query keeps its k best. A bucket of more than ``crowded`` vectors is dealt into parts, which its queries visit each.
    Null and empty vectors and null keys are left out; all vectors must have as many numbers. Without queries or vectors
    there are no rows.
    """
    q, v = _vectors(queries, key, vector), _vectors(vectors, key, vector)
    kind = v.schema["id"].dataType.simpleString()
    n, wide = v.agg(F.count("*"), F.max(F.size("v"))).first()
    wide = wide or q.agg(F.max(F.size("v"))).first()[0] or 1  # queries without a vector to meet are hashed as well
    most = min(40, max(1, round(np.log2(max(2, n / bucket_rows)))))
    planes = np.random.default_rng(seed).normal(size=(wide, tables, most))
    planes = np.ascontiguousarray(planes[..., : _fitted_bits(q, v, k, planes, probes, recall, sample)])
    sizes = _hashed(v, kind, planes, 0, vectors=False).groupBy("table", "bucket").agg(F.ceil(F.count("*") / crowded).cast("int").alias("parts"))
    full, parts = materialize(sizes.where("parts > 1"), "full"), F.coalesce("parts", F.lit(1))
    held = _hashed(v, kind, planes, 0).join(full, ["table", "bucket"], "left").select("table", "bucket", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id", "v")
    asked = _hashed(q, kind, planes, probes).join(full, ["table", "bucket"], "left").select("table", "bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "id", "v")
    met = [df.groupBy("table", "bucket", "part") for df in (asked, held)]
    scored = met[0].cogroup(met[1]).applyInPandas(lambda some, all_: _most_similar(some, all_, k), f"query {kind}, neighbour {kind}, similarity double")
    scored = scored.groupBy("query", "neighbour").agg(F.max("similarity").alias("similarity"))  # met in several tables
    return top_k_per_group(scored, ["query"], [F.desc("similarity"), F.col("neighbour")], k, "rank")


def _split(sample: np.ndarray, leaves: int) -> list[tuple]:
    """A k-d tree of about ``leaves`` leaves: (column, cut, left, right), or a leaf's number alone, the root first. The
    widest column of the largest leaf is cut at its median, next values being kept together."""
    tree: list[tuple] = [()]
    open_ = [(0, sample)]
    done = 0
    while open_ and len(open_) + done < leaves:
        open_.sort(key=lambda x: len(x[1]))
        at, rows = open_.pop()
        wide = int(np.argmax(rows.max(0) - rows.min(0))) if len(rows) else 0
        cut = float(np.median(rows[:, wide])) if len(rows) else 0.0
        low = rows[:, wide] < cut if len(rows) else np.zeros(0, bool)
        if not low.any():
            low = rows[:, wide] <= cut if len(rows) else low
            cut = float(np.nextafter(cut, np.inf))
        if not len(rows) or low.all():
            tree[at] = (done,)
            done += 1
            continue
        tree[at] = (wide, cut, len(tree), len(tree) + 1)
        open_ += [(len(tree), rows[low]), (len(tree) + 1, rows[~low])]
        tree += [(), ()]
    for at, _ in open_:
        tree[at] = (done,)
        done += 1
    return tree


def _leaf(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    open_ = [(0, np.arange(len(x)))]
    while open_:
        at, rows = open_.pop()
        node = tree[at]
        if len(node) == 1:
            out[rows] = node[0]
        elif len(rows):
            low = x[rows, node[0]] < node[1]
            open_ += [(node[2], rows[low]), (node[3], rows[~low])]
    return out


def _nearest(x: np.ndarray, y: np.ndarray, ids: list[list], most: int, reach: np.ndarray) -> list[list[tuple]]:
    """Of each row of ``x`` the ``most`` smallest (distance, id) of the rows of ``y`` that are no farther than ``reach``."""
    names = np.array([i for some in ids for i in some], dtype=object)
    row = np.repeat(np.arange(len(ids)), [len(some) for some in ids])
    order = np.argsort(names, kind="stable")
    names, row = names[order], row[order]
    out = []
    step = max(1, 2_000_000 // max(1, len(row)))
    for a in range(0, len(x), step):
        some = x[a : a + step]
        square = np.zeros((len(some), len(y)))
        for c in range(x.shape[1]):
            square += (some[:, c : c + 1] - y[None, :, c]) ** 2
        far = np.sqrt(square)[:, row]
        top = np.argsort(far, axis=1, kind="stable")[:, :most]
        for i, (d, ns) in enumerate(zip(np.take_along_axis(far, top, 1), names[top])):
            out.append([(float(p), q) for p, q in zip(d, ns) if p <= reach[a + i]])
    return out


def self_neighbours(points: DataFrame, key: str, columns: list[str], k: int, cell_rows: int = 1024, most_cells: int = 4096, visitors: int = 20_000) -> DataFrame:
    """``(query, neighbour, distance, rank)``: the exact k nearest other points of each point of a table (ties: the smaller
    key), by the distance of ``columns``.

    Points of one position count as one place that knows its k + 1 smallest keys, so copies make no pairs. Places are dealt
    to the cells of a k-d tree, which is grown on a sample of at most 16 places a cell; the sample decides about speed
    alone. Each cell finds the best of its own places; then a place visits, of the cells that its k-th distance reaches, the
    8 nearest, then up to the 64th, then all that are left. A cell with more than ``visitors`` is visited in parts. Points
    with a null among the key or the columns are left out, equal rows are one point, an empty table gives no rows.
    """
    kind = points.schema[key].dataType.simpleString()
    p = points.select(column(key).alias("id"), *[column(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).dropna().distinct()
    xs, most = [f"x{i}" for i in range(len(columns))], k + 1
    first = p.withColumn("turn", F.row_number().over(Window.partitionBy(*xs).orderBy("id"))).where(F.col("turn") <= most)
    places = first.groupBy(*xs).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    places = materialize(places.withColumn("place", F.monotonically_increasing_id()), "places")
    cells = int(min(most_cells, max(1, -(-places.count() // cell_rows))))
    sample = places.select(*xs).orderBy(F.xxhash64("place")).limit(16 * cells).toPandas()
    tree = _split(sample[xs].to_numpy(float).reshape(-1, len(xs)), cells)

    @F.pandas_udf("long")
    def cell_of(*values: pd.Series) -> pd.Series:
        return pd.Series(_leaf(tree, np.stack([v.to_numpy(float) for v in values], 1)))

    dealt = materialize(places.withColumn("cell", cell_of(*xs)), "dealt")
    discard(places)
    bounds = [f(x).alias(f"{name}{x}") for x in xs for name, f in (("a", F.min), ("b", F.max))]
    boxes = dealt.groupBy("cell").agg(F.count("*").alias("n"), *bounds).orderBy("cell").toPandas()  # a row a cell, most_cells at most
    low, high, names = boxes[[f"a{x}" for x in xs]].to_numpy(float), boxes[[f"b{x}" for x in xs]].to_numpy(float), boxes["cell"].to_numpy()
    best_type = f"array<struct<d:double,id:{kind}>>"

    def told(place: pd.Series, found: list) -> pd.DataFrame:
        best = pd.Series([[{"d": d, "id": i} for d, i in some] for some in found], dtype=object)
        return pd.DataFrame({"place": place.to_numpy(), "best": best})

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[xs].to_numpy(float)
        return told(pdf["place"], _nearest(x, x, pdf["ids"].tolist(), most, np.full(len(x), np.inf)))

    def meet(guests: pd.DataFrame, hosts: pd.DataFrame) -> pd.DataFrame:
        if guests.empty or hosts.empty:
            return told(guests["place"][:0], [])
        return told(guests["place"], _nearest(guests[xs].to_numpy(float), hosts[xs].to_numpy(float), hosts["ids"].tolist(), most, guests["reach"].to_numpy(float)))

    def visits(start: int, end: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for pdf in (whole.iloc[a : a + 256] for a in range(0, len(whole), 256)):
                    x = pdf[xs].to_numpy(float)
                    square = np.zeros((len(x), len(names)))
                    for c in range(len(xs)):
                        at = x[:, c : c + 1]
                        square += np.maximum(0, np.maximum(low[None, :, c] - at, at - high[None, :, c])) ** 2
                    far = np.sqrt(square) * (1 - 1e-9)  # rounding must not hide a cell
                    far[names[None, :] == pdf["cell"].to_numpy()[:, None]] = np.inf
                    order = np.argsort(far, axis=1, kind="stable")[:, start:end]
                    row, col = np.nonzero(np.take_along_axis(far, order, 1) <= np.minimum(pdf["reach"].to_numpy(float), 1.7e308)[:, None])
                    made = pdf.iloc[row][["place", *xs, "reach"]].copy()
                    made["cell"] = names[order[row, col]]
                    yield made

        return run

    state = materialize(dealt.groupBy("cell").applyInPandas(own, f"place long, best {best_type}").join(dealt.select("place", "cell", *xs), "place"), "nearest")
    reach = F.when(F.size("best") == most, F.element_at("best", -1)["d"]).otherwise(F.lit(float("inf")))
    for start, end in ((0, 8), (8, 64), (64, most_cells)):
        if len(names) - 1 <= start:
            break
        asked = state.withColumn("reach", reach).mapInPandas(visits(start, end), ", ".join(["place long", *[f"{x} double" for x in xs], "reach double", "cell long"]))
        asked = materialize(asked, "visits")
        parts = asked.groupBy("cell").agg(F.ceil(F.count("*") / visitors).cast("int").alias("parts"))  # a row a cell
        guests = asked.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("place"), F.col("parts")).cast("int"))
        hosts = dealt.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        found = guests.select("cell", "part", "place", "reach", *xs).groupBy("cell", "part").cogroup(hosts.select("cell", "part", "ids", *xs).groupBy("cell", "part"))
        found = found.applyInPandas(meet, f"place long, best {best_type}").groupBy("place").agg(F.flatten(F.collect_list("best")).alias("more"))
        both = F.slice(F.array_sort(F.concat("best", F.coalesce("more", F.array().cast(best_type)))), 1, most)
        before, state = state, materialize(state.join(found, "place", "left").select("place", both.alias("best"), "cell", *xs), "nearest")
        discard(before, asked)
    near = p.join(state.select("best", *xs), xs).select(F.col("id").alias("query"), F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k).alias("best"))
    near = near.select("query", F.posexplode("best").alias("at", "b"))
    return near.select("query", F.col("b.id").alias("neighbour"), F.col("b.d").alias("distance"), (F.col("at") + 1).alias("rank"))
