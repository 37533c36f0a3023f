"""Levels of tool calls against a plain longest path, and the number of rounds."""

import random

import pytest

from quayside.llm import tool_calls


def plain(edges, n):
    level, state = {}, {}

    def of(k):
        if state.get(k) == "open":
            return None
        if k not in state:
            state[k] = "open"
            below = [of(d) for d in edges.get(k, []) if 0 <= d < n]
            state[k] = "done"
            level[k] = None if None in below else max((b + 1 for b in below), default=0)
        return level[k]

    # Calls of a cycle, and those behind one, have no level: what was seen open is looked at until nothing changes.
    for k in range(n):
        of(k)
    while True:
        again = {k: None if level[k] is None or any(level[d] is None for d in edges.get(k, []) if 0 <= d < n) else level[k] for k in range(n)}
        if again == level:
            return {k: v for k, v in level.items() if v is not None}
        level = again


def levels(spark, edges, n, monkeypatch=None):
    made = []
    if monkeypatch:
        keep = tool_calls.materialize
        monkeypatch.setattr(tool_calls, "materialize", lambda df, name, **o: made.append(name) or keep(df, name, **o))
    rows = [("c", str(k), [str(d) for d in edges.get(k, [])]) for k in range(n)]
    got = tool_calls.order_calls(spark.createDataFrame(rows, "conv_id string, call_id string, depends array<string>"), ["conv_id", "call_id"])
    return {int(r.call_id): r.level for r in got.collect()}, len(made)


@pytest.mark.parametrize("n, back, most", [(64, (1,), 9), (64, (1, 2), 10), (60, (1, 2, 5), 10)])
def test_ladders(spark, monkeypatch, n, back, most):
    edges = {k: [k - b for b in back if k >= b] for k in range(n)}
    got, tables = levels(spark, edges, n, monkeypatch)
    assert got == {k: k for k in range(n)} == plain(edges, n) and tables <= most


@pytest.mark.parametrize("wide", [64, 2])
def test_graphs(spark, monkeypatch, wide):
    monkeypatch.setattr(tool_calls, "WIDE", wide)
    rng = random.Random(wide)
    n = 40
    edges = {k: [rng.randrange(k) for _ in range(rng.randint(0, 4))] for k in range(1, n)}
    edges[39] = [*range(39), 77]
    edges[5] = [*edges[5], 9]
    edges[9] = [*edges[9], 5]
    edges[12] = [12]
    assert levels(spark, edges, n)[0] == plain(edges, n)
