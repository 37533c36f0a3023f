"""What a task holds while it contracts edges."""

import subprocess
import sys

import pyarrow as pa
import pytest

from conftest import ROOT
from quayside.functions.graph import CHUNK_EDGES, _forest

HELD = """
import resource
import numpy as np, pyarrow as pa
from quayside.functions.graph import _forest
r, n = np.random.default_rng(1), {edges}
held = [pa.RecordBatch.from_arrays([pa.array(r.integers(0, 9 * n, 10000)) for _ in "uv"], names=["u", "v"]) for _ in range(n // 10000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert _forest(held).num_rows > n
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_chunk_of_edges_is_contracted_in_little_memory():
    made = subprocess.run([sys.executable, "-c", HELD.format(edges=CHUNK_EDGES)], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120)
    assert int(made.stdout) < 200  # MB


@pytest.mark.parametrize("kind", [pa.int64(), pa.int32(), pa.string()])
def test_ends_are_numbered_in_their_order(kind):
    edges = [(30, 20), (20, 41), (77, 77), (50, 60), (60, 50), (99, 60)]
    held = [pa.RecordBatch.from_arrays([pa.array([e[i] for e in part]).cast(kind) for i in (0, 1)], names=["u", "v"]) for part in (edges[:4], edges[4:])]
    made = _forest(held)
    assert made.schema.types == [kind, kind]
    got = {int(str(a)): int(str(b)) for a, b in zip(*(c.to_pylist() for c in made.columns))}
    assert got == {20: 20, 30: 20, 41: 20, 77: 77, 50: 50, 60: 50, 99: 50}
