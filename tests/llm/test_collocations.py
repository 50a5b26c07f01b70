"""Collocations: the index against plain counting, the operator against brute force."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegrove.llm.collocations import SQL, collocations, count_words, make_shards, op11
from sitegrove.llm.common import write_out
from sitegrove.llm.fm_index import FmIndex

LOWER = {c: c + 32 for c in range(65, 91)}


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute(docs, min_count=10, top=2000, cover=50):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40))
def test_index_counts_every_pattern(seq):
    seq = np.array([*seq, 0])
    index = FmIndex(seq, 4)
    words = index.words()
    right = index.extend_right(words)
    levels = [words, right, index.extend_left(words), index.extend_left(right), index.extend_right(index.extend_left(words))]
    for x, k in zip(levels, (1, 2, 2, 3, 3)):
        exp = Counter(tuple(seq[i:i + k].tolist()) for i in range(len(seq) - k + 1) if (seq[i:i + k] > 0).all())
        assert {tuple(w): c for w, c in zip(x.words.tolist(), x.count.tolist())} == exp
    order = sorted(range(len(seq)), key=lambda i: (seq[i], seq[(i + 1) % len(seq)]))
    for w, c, lo in zip(right.words.tolist(), right.count.tolist(), right.lo.tolist()):
        assert all(seq[i] == w[0] and seq[i + 1] == w[1] for i in order[lo:lo + c])


def _docs(seed):
    rnd = random.Random(seed)
    vocab = ["the", "The", "a", "of", "new", "york", "city", "é", "Éa", "x y", "-", "日本", "ß"] + [f"w{i}" for i in range(8)]
    def text():
        return "".join(rnd.choice(vocab) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "\x0b", " new york city "]) for _ in range(rnd.randint(0, 80)))
    docs = [(rnd.choice(["en", "en", "en", "de", None, "und"]), text()) for _ in range(150)]
    return docs + [("en", None), ("fr", ""), (None, None), ("es", " \t\n.")] + [("en", "same row twice over and over")] * 30


@pytest.mark.parametrize("shard_words", [2_000_000, 500, 7])
def test_against_brute_force(spark, shard_words):
    docs = _docs(shard_words)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in collocations(df, shard_words=shard_words).collect())
    assert got == brute(docs) and len(got) > 20
    got = sorted(tuple(r) for r in collocations(df, min_count=3, top=7, max_words=3, cover=90, shard_words=shard_words).collect())
    assert got == brute(docs, 3, 7, 90)


def test_cut_pieces_count_once(spark):
    text = " ".join(f"w{i % 5}" for i in range(1000))
    df = spark.createDataFrame([("en", text)], "lang string, text string")
    shards = write_out(make_shards(df, 10), "test")
    assert shards.where("size < 0").count() > 40
    assert {r.word: r.f for r in count_words(shards).collect()} == {f"w{i}": 200 for i in range(5)}
    assert sorted(tuple(r) for r in collocations(df, shard_words=10).collect()) == brute([("en", text)])


def test_products_beyond_64_bits(spark):
    a = spark.range(1).selectExpr("cast(3000000000000 as long) a", "cast(3000000000001 as long) l")
    x = "cast(a as decimal(15, 0))"
    assert a.selectExpr(f"(1000000 * {x} * {x}) div (cast(l as decimal(15, 0)) * {x})").first()[0] == 1000000 * 3000000000000 // 3000000000001


def test_odd_tables(spark, odd_docs, no_docs):
    assert collocations(no_docs).count() == 0
    got = sorted(tuple(r) for r in collocations(odd_docs).collect())
    assert got == brute([(r.lang, r.text) for r in odd_docs.collect()])
    assert collocations(odd_docs, min_count=10**6).count() == 0


def test_query(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_small}/documents.parquet'")
    df = op11(spark, sf_small)
    exp = con.execute(SQL).fetchdf()
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r) for r in exp[df.columns].itertuples(index=False, name=None))
    assert all(t == "bigint" for c, t in df.dtypes if c not in ("lang", "phrase"))
