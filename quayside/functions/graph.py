"""Connected components by local contraction.

Each task contracts the edges it happens to hold, a chunk at a time, to a forest: every node with the smallest node it
reaches there. A node that got several roots from different chunks links those roots, and only these links go on to the
next level; there are fewer of them each time, and once they fit into one chunk they are settled. A level is one
grouping, with as many rows a node as there are chunks that hold it, and ends in a written table. The driver sees
whether any link is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.scratch import materialize

CHUNK_EDGES = 1 << 20  # edges that a task contracts at once


def _smallest_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1, the smallest node that the edges (a, b) connect it with."""
    root = np.arange(n, dtype=a.dtype)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above


def _numbered(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The distinct ends of the edges in order, and the place there of each first, then each second end."""
    kind = table.schema.field(0).type
    chunks = [c for column in table.columns for c in column.chunks]
    if pa.types.is_integer(kind):  # by sorting, as a hash table takes several times the room
        ends = np.concatenate([c.to_numpy() for c in chunks])
        nodes = np.sort(ends)
        nodes = nodes[np.append(True, nodes[1:] != nodes[:-1])]
        code = np.empty(len(ends), np.int32)
        for at in range(0, len(ends), 1 << 16):
            code[at : at + (1 << 16)] = np.searchsorted(nodes, ends[at : at + (1 << 16)])
        return pa.array(nodes, kind), code
    encoded = pa.chunked_array(chunks, kind).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(encoded.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return encoded.dictionary.take(pa.array(order)), place[encoded.indices.to_numpy()]


def _forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    nodes, code = _numbered(table)
    root = _smallest_reached(code[: table.num_rows], code[table.num_rows :], len(nodes))
    return pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root))], names=["node", "root"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_levels: int = 60, chunk_edges: int = CHUNK_EDGES) -> DataFrame:
    """Component of every node that has an edge: ``(node, component)``, the component being its smallest node.

    Null ends are ignored, a loop makes a component of one node, repeated edges count once, and an empty edge table
    gives an empty result. Raises RuntimeError if links are left after ``max_levels``.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk_edges:
                yield _forest(held)
                held, n = [], 0
        if n:
            yield _forest(held)

    kind = edges.schema[src].dataType.simpleString()
    level = edges.select(F.col(src).alias("u"), F.col(dst).cast(kind).alias("v")).where("u is not null and v is not null")
    tables = []
    for _ in range(max_levels):
        found = level.mapInArrow(contract, f"node {kind}, root {kind}").groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"))
        table = materialize(found.select("node", "root", F.filter("roots", lambda r: r != F.col("root")).alias("more")), "forest")
        tables.append(table)
        level = table.where("size(more) > 0").select(F.col("root").alias("u"), F.explode("more").alias("v"))
        if level.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_levels} levels")
    labels = tables[-1].select("node", F.col("root").alias("component"))
    for table in reversed(tables[:-1]):
        above = labels.select(F.col("node").alias("root"), "component")
        labels = table.select("node", "root").join(above, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
    return labels
