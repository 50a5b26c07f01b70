"""Jaccard join against all pairs; blocks; edge cases."""

import random
import re
from itertools import combinations

import numpy as np

from sitegrove.llm.components import components
from sitegrove.llm.lsh_forest import Forest, _least_roots_across, jaccard_join, links_between, one_of_each_group


def grams(t, n=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(docs, threshold=0.8):
    """docs: rows (doc_id, text). (class_id, n_links) of each row."""
    sets = [grams(t) for _, t in docs]
    links, root = [0] * len(docs), list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) / len(a | b) >= threshold:
            links[i] += 1
            links[j] += 1
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    least = {g: min([d for d in ds if d is not None], default=None) for g, ds in groups.items()}
    return sorted(((d, least[find(i)], links[i]) for i, (d, _) in enumerate(docs)), key=str)


def near_copies(rnd, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_matches_all_pairs(spark):
    rnd = random.Random(8)
    texts = []
    for g in range(12):
        base = [f"g{g}w{rnd.randrange(400)}" for _ in range(rnd.randint(30, 160))]
        texts += near_copies(rnd, base, rnd.choice([1, 2, 5, 60]), 4)
    texts += ["a b c", "A, b! c?", "", "one", None, "..."]
    docs = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    exp = brute(docs)
    for kw in ({}, {"block_members": 7}, {"block_grams": 900}):
        got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(df, recall=0.9999, **kw).collect()), key=str)
        assert got == exp


def test_links_across_blocks_keep_a_chain_whole(spark):
    rnd = random.Random(3)
    docs = []
    for size in (3, 4, 40):  # a text has 19 of 23 n-grams in common with the next one, at most 17 of 25 with any other
        words = [f"c{size}w{k}" for k in range(25 + 2 * size)]
        docs += [" ".join(words[2 * k:2 * k + 25]) for k in range(size)]
    rnd.shuffle(docs)
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    exp = brute(docs)
    assert len({c for _, c, _ in exp}) == 3
    for members in (2, 3, 5):
        got = jaccard_join(df, recall=0.99999, block_members=members).collect()
        assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == exp


def test_roots_across_a_matrix_of_links():
    a, b = np.array([2, 1, 9]), np.array([3, 4, 8])
    linked = np.array([[True, True, False], [False, True, False], [False, False, False]])
    got = _least_roots_across(a, b, linked)
    assert [x.tolist() for x in got] == [[1, 1, 9], [1, 1, 8]]


def test_links_between_matches_sets():
    rnd = random.Random(4)
    sets = [np.array(sorted(rnd.sample(range(40), rnd.randint(1, 30))), np.uint64) for _ in range(40)]
    got = links_between(sets[:25], sets[25:], 0.5, columns=7)
    for i, a in enumerate(sets[:25]):
        for j, b in enumerate(sets[25:]):
            x, y = set(a.tolist()), set(b.tolist())
            assert got[i, j] == (len(x & y) / len(x | y) >= 0.5)


def test_prefixes_shorten_to_the_recall():
    f = Forest(24, 8)
    n = f.prefix_length(0.8, 0.999)
    assert 1 - (1 - 0.8 ** n) ** 24 >= 0.999 > 1 - (1 - 0.8 ** (n + 1)) ** 24
    assert f.prefix_length(0.99, 0.9) == 8


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    rows = jaccard_join(odd_docs).collect()
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in rows), key=str) == brute(docs)
    assert jaccard_join(no_docs).count() == 0


def test_one_stays(odd_docs, no_docs):
    kept = one_of_each_group(odd_docs)
    assert kept.schema == odd_docs.schema
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9, None, None]  # 1, 2 and 2 again are one group
    assert one_of_each_group(no_docs).count() == 0


def test_ordered_chains(spark):
    """Each text is similar to the next one only; ids run along the chain, either way."""
    words = [f"w{i}" for i in range(1000)]
    docs = [(i, " ".join(words[i * 2:i * 2 + 27])) for i in range(400)]
    for rows in (docs, [(399 - i, t) for i, t in docs]):
        got = sorted((tuple(r) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect()), key=str)
        assert got == brute(rows) and {c for _, c, _ in got} == {0}
