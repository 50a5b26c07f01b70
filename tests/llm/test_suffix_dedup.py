"""Suffix sorting against sorted suffixes; removal against a direct count."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegrove.llm import suffix_dedup
from sitegrove.llm.suffix_dedup import remove_repeats
from sitegrove.llm.suffix_sort import suffix_array


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(x):
    assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[p:p + length] for b in bodies for p in range(len(b) - length + 1))
    out = []
    for b in bodies:
        runs = []
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + length
                else:
                    runs.append([p, p + length])
        cut = bytearray(b)
        for s, e in reversed(runs):
            del cut[s:e]
        out.append((len(b), bytes(cut), tuple(map(tuple, runs))))
    return sorted(out)


def run(df, **kw):
    return sorted((r.n_bytes, bytes(r.kept), tuple((x.start, x.end) for x in r.runs)) for r in remove_repeats(df, **kw).collect())


def texts_with_repeats(rnd, n):
    alphabet = "abcé "
    shared = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([30, 60, 200]))) for _ in range(5)]
    out = []
    for _ in range(n):
        t = "".join("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) + (s := rnd.choice(shared))[rnd.randint(0, 12):len(s) - rnd.randint(0, 12)]
                    for _ in range(rnd.randint(0, 4)))
        out.append(t)
    return out + ["ab" * 60, out[0], out[0], "x" * 100]


@pytest.mark.parametrize("kw", [{}, {"cell": 5}, {"sort_limit": 1}, {"sample_docs": 1}, {"sort_limit": 3, "cell": 4}])
def test_matches_direct_count(spark, kw):
    texts = texts_with_repeats(random.Random(6), 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert run(df, length=24, gram=8, **kw) == brute(texts, 24)


def test_hot_grams_and_long_texts(spark, monkeypatch):
    rnd = random.Random(2)
    line = "a line that a third of all documents hold in the same words"
    texts = [("".join(rnd.choice("abc ") for _ in range(80)) + (line if i % 3 == 0 else "") + "".join(rnd.choice("abc ") for _ in range(80))) for i in range(90)]
    texts += [texts[1]] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert run(df, length=24, gram=8, sample_docs=10_000) == brute(texts, 24)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 500)
    body = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    data = __import__("numpy").frombuffer(body.encode(), "uint8")
    pieces = list(suffix_dedup._pieces(data, __import__("numpy").array([0, 3000]), 24))
    starts = sorted(s + at for _, at, part, _ in pieces for s in range(len(part) - 23))
    assert starts == list(range(3000 - 23))


def test_odd_rows(odd_docs, no_docs):
    texts = [r.text for r in odd_docs.collect()]
    assert run(odd_docs) == brute(texts, 200)
    assert remove_repeats(no_docs).count() == 0
