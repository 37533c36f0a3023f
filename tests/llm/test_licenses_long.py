"""Licence expressions of any length."""

from __future__ import annotations

import time

from quayside.llm import licenses


def test_long_chain_keeps_every_label():
    names = [f"L-{i:03}" for i in range(100)]
    labels, shown = licenses.parse_expression(" OR ".join(names) + " */")
    assert labels == [n.lower() for n in names]
    assert shown == " OR ".join(names)


def test_long_parentheses_and_a_sentence_after_them():
    names = [f"L-{i:03}" for i in range(100)]
    labels, shown = licenses.parse_expression(f"({' OR '.join(names)}) AND Z see (the rest")
    assert labels == [*(n.lower() for n in names), "z"]
    assert shown == f"({' OR '.join(names)}) AND Z"


def test_longest_head_and_time_of_a_huge_line():
    start = time.monotonic()
    names = [f"L-{i:05}" for i in range(30_000)]
    assert len(licenses.parse_expression(" AND ".join(names))[0]) == 30_000
    assert licenses.parse_expression("A OR " + "(" * 30_000 + "B") == (["a"], "A")
    assert licenses.parse_expression("(" * 30_000 + "B" + ")" * 30_000) == (["b"], "B")
    assert len(licenses.parse_expression(" OR (".join(names) + ")" * 29_999)[0]) == 30_000
    assert time.monotonic() - start < 20
