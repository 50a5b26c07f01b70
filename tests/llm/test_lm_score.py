"""Base score against a direct count; the model is normalised and better than
the base on held-out text; edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegrove.llm import lm_score
from sitegrove.llm.common import table

SF = "/root/testdata/sf0.01"


def tokens(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t) + ["\n"]


def check_base(rows, docs, learn):
    c = Counter(w for i, t in docs if learn(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    exp = sorted((str(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in docs)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == exp


def test_query(spark):
    rows = lm_score.op10(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    check_base(rows, docs, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in rows)


def test_small_head_and_vocabulary_give_the_same_base(spark):
    docs = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 30))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lm_score.language_scores(df, F.col("doc_id") % 3 != 0, vocabulary=4, head=9).collect()
    check_base(rows, docs, lambda i: i % 3 != 0)


def test_probabilities_add_up(spark):
    """All words known in training, one unseen word and the end, after a word."""
    docs = [(i, " ".join(f"w{(i * k) % 11}" for k in range(1, 20))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ask = spark.createDataFrame([(100 + i, f"w1 {w}") for i, w in enumerate([*(f"w{i}" for i in range(11)), "unseen"])] + [(99, "w1")], "doc_id long, text string")
    rows = {r.doc_id: r for r in lm_score.language_scores(df.unionByName(ask), F.col("doc_id") < 99, vocabulary=5).collect()}
    # p(w1 end) / p(w1) is the end's share after w1; the scores of 'w1 x' hold p(x | w1) p(end | x)
    counts = lm_score.write_out(lm_score.count_words(df), "t-counts")
    words = lm_score.frequent_words(counts, 100, 5)
    model = lm_score.train(lm_score.write_out(lm_score.count_pairs(df, words), "t-pairs"), words)
    p = np.exp(model.R @ model.Q.T + model.b - model.log_normalisers()[:, None])
    assert p.sum(1) == pytest.approx(1, abs=1e-4)
    assert len(rows) == 30 + 13 and rows[111].n_known == 2  # w1 and the end


def test_odd_rows(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check_base(lm_score.language_scores(odd_docs, F.lit(True)).collect(), docs, lambda i: True)
    check_base(lm_score.language_scores(odd_docs, F.lit(False)).collect(), docs, lambda i: False)
    assert lm_score.language_scores(no_docs, F.lit(True)).count() == 0
