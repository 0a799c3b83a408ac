"""Connected components against a union-find: random graphs, chains, a hot star; components of threads."""

import random

import pytest

from postlake.operators.components import contract, thread_components


def _plain(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            parent[find(a)] = find(b)
    least = {}
    for x in parent:
        least[find(x)] = min(x, least.get(find(x), x))
    return {x: least[find(x)] for x in parent}


def _found(spark, pairs, kind="long"):
    labels, rounds = contract(spark.createDataFrame(pairs, f"a {kind}, b {kind}"))
    rows = [tuple(r) for r in labels.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return dict(rows), rounds


@pytest.mark.parametrize("n, links", [(40, 30), (300, 320)])
def test_components_of_random_graphs(spark, n, links):
    rng = random.Random(n)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(links)] + [(None, 1), (2, None), (5, 5)]
    got, _ = _found(spark, pairs)
    assert got == _plain(pairs)


def test_rounds_grow_with_the_logarithm(spark):
    order = list(range(3000))
    random.Random(4).shuffle(order)
    chain = list(zip(order, order[1:]))
    got, rounds = _found(spark, chain)
    assert set(got.values()) == {0} and len(got) == 3000 and rounds <= 16
    got, rounds = _found(spark, [(k, k + 1) for k in range(3000)])
    assert set(got.values()) == {0} and rounds <= 16


def test_hot_star_and_strings(spark):
    star = [(f"m{k}", "root") for k in range(600)] + [(f"x{k}", f"y{k}") for k in range(1000)] + [("m1", "m2")] * 50
    got, rounds = _found(spark, star, "string")
    assert got == _plain(star) and rounds <= 4


def test_no_links(spark):
    assert _found(spark, []) == ({}, 0)
    assert _found(spark, [(None, 1), (3, 3)]) == ({}, 0)


def test_thread_components_share_any_id(spark):
    rows = [(1, "a", []), (2, "b", ["a"]), (3, "c", ["missing"]), (4, "d", ["missing", "e"]), (5, "f", None), (6, "g", ["e"]), (7, "b", ["z"]), (8, None, ["a"])]
    m = spark.createDataFrame(rows, "doc_id long, msgid string, refs array<string>")
    got = {r["doc_id"]: r["component"] for r in thread_components(m).collect()}
    assert got == {1: "a", 2: "a", 7: "a", 3: "c", 4: "c", 6: "c", 5: "f", 8: None}
