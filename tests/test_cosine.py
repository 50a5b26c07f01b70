"""Near match by cosine against all pairs."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from sitegrove.operators.cosine import cosine_groups, prefix_size
from sitegrove.operators.pairs import verify


def _vector(text, k=5):
    w = (text or "").lower().split(" ")
    return Counter(tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1)))


def _brute(docs, percent):
    v = [_vector(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in combinations(range(len(docs)), 2):
        d = sum(n * v[j][g] for g, n in v[i].items())
        if d * d * 10_000 >= percent ** 2 * sum(n * n for n in v[i].values()) * sum(n * n for n in v[j].values()):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), key), key)
    return {key: least[find(i)] for i, (key, _) in enumerate(docs)}


def _docs():
    rnd = random.Random(17)
    words = [f"w{i}" for i in range(300)]
    boiler = " ".join(f"b{i}" for i in range(25))  # in most texts: the frequent shingles
    docs = []
    for family in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([8, 40, 120]))]
        base += base[:6] * rnd.choice([0, 0, 6])  # counts above one
        for _ in range(rnd.randint(1, 7)):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            docs.append((" ".join(w) + (" " + boiler if rnd.random() < 0.7 else "")))
    docs += ["", "", None, "short one", "short one", "Short ONE", "a b c d e", docs[0].upper()]
    return list(enumerate(docs))


@pytest.mark.parametrize("percent, frequent, members", [(80, 100_000, 1024), (80, 10, 3), (60, 1, 1024), (95, 10, 2)])
def test_groups_equal_all_pairs(spark, percent, frequent, members):
    docs = _docs()
    df = spark.createDataFrame(docs, "id long, t string")
    got = {r.id: r.group_id for r in cosine_groups(df, "id", "t", percent=percent, frequent=frequent, block_members=members).collect()}
    assert got == _brute(docs, percent) and 5 < len(set(got.values())) < len(docs)


def test_prefix():
    assert prefix_size(np.array([1, 1, 1, 1]), 80) == 2  # two of four hold half the squared length, under 0.64
    assert prefix_size(np.array([3, 1]), 80) == 1 and prefix_size(np.array([1, 3]), 80) == 2 and prefix_size(np.zeros(0), 80) == 0


def test_empty(spark):
    assert cosine_groups(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0


def test_shared_passages_make_no_chain(spark, monkeypatch):
    """Texts that each share passages with the next, too short to link them, are no
    candidates; a pair of near copies among them is."""
    rnd = random.Random(5)

    def words(n):
        return [f"v{rnd.randrange(10 ** 9)}" for _ in range(n)]
    passages = [words(24) for _ in range(41)]
    docs = [words(40) + passages[i] + passages[i + 1] for i in range(40)]
    docs.append([*docs[7][:-1], "other"])
    seen = []

    def counted(members, *args, **kwargs):
        seen.extend(sorted(len(r.set) for r in members.select("set").collect()))
        return verify(members, *args, **kwargs)
    monkeypatch.setattr("sitegrove.operators.cosine.verify", counted)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "id long, t string")
    got = {r.id: r.group_id for r in cosine_groups(df, "id", "t").collect()}
    assert got == {**{i: i for i in range(40)}, 40: 7}
    assert len(seen) == 2
