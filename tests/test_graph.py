"""Connected components: long paths in any order of ids, stars, random graphs."""

import random

import pytest

from sitegrove.operators import graph
from sitegrove.operators.graph import connected_components
from sitegrove.operators.nearmatch import near_match_groups


def _frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def _found(spark, edges):
    return {r.v: r.root for r in connected_components(_frame(spark, edges)).collect()}


@pytest.mark.parametrize("order", ["up", "down", "shuffled", "zigzag"])
def test_long_path(spark, monkeypatch, order):
    """5,000 vertices in logarithmic rounds, however their ids run along the path."""
    steps = []
    store = graph._stored
    monkeypatch.setattr(graph, "_stored", lambda df, name: steps.append(name) or store(df, name))
    n = 5000
    ids = list(range(n))
    if order == "down":
        ids.reverse()
    if order == "shuffled":
        random.Random(3).shuffle(ids)
    if order == "zigzag":
        ids = [i // 2 if i % 2 == 0 else n - 1 - i // 2 for i in range(n)]
    assert set(_found(spark, list(zip(ids, ids[1:]))).values()) == {0}
    assert steps.count("hooks") < 10 and steps.count("jumps") < 40


def test_random_graphs(spark):
    rnd = random.Random(8)
    edges = []
    for base in range(0, 2000, 100):
        k = rnd.randint(1, 99)
        edges += [(base + rnd.randint(0, k), base + rnd.randint(0, k)) for _ in range(rnd.randint(1, 120))]
    edges += [(5000, 5000 + i) for i in range(1, 300)] + [(7000, 7000)] + [(6001, 6000)] * 5
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert _found(spark, edges) == {v: find(v) for v in root}


def test_no_edges(spark):
    assert _found(spark, []) == {} == _found(spark, [(1, 1)])


def test_ordered_chain_of_near_copies(spark):
    """A sliding window over words: each text is similar to the next one only."""
    words = [f"w{i}" for i in range(2000)]
    docs = [(i, " ".join(words[i * 4:i * 4 + 80])) for i in range(400)]
    for rows in (docs, [(399 - i, t) for i, t in docs]):
        g = {r.id: r.group_id for r in near_match_groups(spark.createDataFrame(rows, "id long, t string"), "id", "t", bands=32, rows=2).collect()}
        assert set(g.values()) == {0}
