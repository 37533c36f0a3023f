"""Queries that cover their whole tables, against brute force."""

from __future__ import annotations

from quayside.jobs.catalog import QUERIES


def test_linked_entities_of_all_events(spark, sf):
    name = "ano6_linked_entities_whole"
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", "value").collect()
    root = {r.user_id: r.user_id for r in events}
    by_value: dict = {}
    for r in events:
        by_value.setdefault((r.event_type, r.value), set()).add(r.user_id)
    changed = True
    while changed:
        changed = False
        for users in by_value.values():
            least = min(root[u] for u in users)
            for u in users:
                changed |= root[u] != least
                root[u] = least
    assert {r.user_id: r.group for r in QUERIES[name](spark, sf).collect()} == root


def test_ranking_features_of_all_customers_with_orders(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    owner = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey").collect()}
    got = [(r.u, r.p) for r in QUERIES["jon5_ranking_features_whole"](spark, sf).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(owner[r.l_orderkey], r.l_partkey) for r in lines if r.l_orderkey in owner}
