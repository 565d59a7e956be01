"""Queries over whole tables against brute force."""

import random

from sievework.plans import registry

DATA = "/root/testdata/sf0.001"


def components(edges):
    label = {}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for e in edges:
        a, b = sorted(root(label.setdefault(x, x)) for x in e)
        label[b] = a
    return {x: root(x) for x in label}


def test_components_with_hubs(spark, monkeypatch):
    from sievework.operators import components as module

    monkeypatch.setattr(module, "HUB", 20)
    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 200)] + [(500 + rng.randrange(60), 500 + rng.randrange(60)) for _ in range(70)] + [(9, None), (900, 900)]
    got = module.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    want = components((a, b) for a, b in edges if b is not None and a != b)
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_components_of_all_parts(spark):
    lines = registry.table(spark, DATA, "lineitem").select("l_partkey", "l_suppkey").collect()
    got = registry.QUERIES["components_of_parts"](spark, DATA).collect()
    want = components((r.l_partkey + 1000000, r.l_suppkey) for r in lines)
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_groups_of_all_orders(spark):
    least, orders = {}, registry.table(spark, DATA, "orders").select("o_orderkey", "o_custkey").collect()
    for r in orders:
        least[r.o_custkey] = min(least.get(r.o_custkey, r.o_orderkey), r.o_orderkey)
    got = registry.QUERIES["shared_key_groups"](spark, DATA).collect()
    assert len(got) == len(orders) and {r["case"]: r["group"] for r in got} == {r.o_orderkey: least[r.o_custkey] for r in orders}
