"""Byte-level BPE: ids as the public library's, exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegrove.llm.byte_bpe import ByteBpe, Merges, PerfectHash, build, decode, encode, hash_keys, op12, read_ranks, round_trip

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TOKENS = read_ranks(PATH)
RANKS = {t: i for i, t in enumerate(TOKENS)}
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE = ByteBpe(*build(TOKENS), PATTERN)


def test_perfect_hash_is_minimal():
    for n in (1, 2, 3, 50, 5000):
        keys = [b"k%d" % i + b"x" * (i % 7) for i in range(n)]
        h = hash_keys(keys)
        assert sorted(PerfectHash(h)(h)) == list(range(n))
    with pytest.raises(ValueError):
        PerfectHash(hash_keys([b"a", b"a"]))


def test_every_token_has_its_slot():
    h = hash_keys(TOKENS)
    assert (BPE.slots[BPE.index(h)] == np.arange(len(TOKENS))).all()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_the_librarys(text):
    assert BPE.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text)


def test_every_character():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 20_000):
        text = "".join(f"a{c}1 {c}" for c in every[at:at + 20_000])
        assert BPE.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text)


def test_long_pre_tokens_and_small_memory():
    rnd = random.Random(4)
    small = ByteBpe(*build(TOKENS), PATTERN, limit=10)
    texts = ["a" * 30_000, "".join(rnd.choice("abcde") for _ in range(20_000)), "é" * 5000, " " * 9999 + "x", "\n\n \n", "<|endoftext|>", "don't we'll I'd THEY'RE"]
    texts += ["".join(rnd.choice(["the ", "wörd", "12", "!?", "\t", "zq", "'s", "漢字", "😀"]) for _ in range(200)) for _ in range(20)]
    for t in texts:
        assert BPE.encode([t])[0].tolist() == small.encode([t])[0].tolist() == LIBRARY.encode_ordinary(t)


def test_merges_alone():
    # the second tier gives the ids also for what the first would have resolved
    merge = Merges([*(bytes([i]) for i in b"abc"), b"ab", b"bc", b"abc", b"aa"])
    assert [merge(x) for x in (b"abc", b"aaa", b"aaaa", b"b", b"")] == [[5], [6, 0], [6, 6], [1], []]
    every = Merges(TOKENS)
    assert all(b"".join(TOKENS[i] for i in every(t * 3)) == t * 3 for t in TOKENS[::97])


def _expected(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_frames(spark, odd_docs, no_docs):
    e = encode(odd_docs, PATH, PATTERN)
    d = decode(e, PATH)
    assert d.columns == ["doc_id", "ids", "decoded"]
    got = sorted(((r.doc_id is None, r.doc_id), r.ids, bytes(r.decoded)) for r in d.collect())
    exp = sorted(((r.doc_id is None, r.doc_id), LIBRARY.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in odd_docs.collect())
    assert got == exp
    assert sorted(((r.doc_id is None, r.doc_id), r.ids, bytes(r.decoded)) for r in round_trip(odd_docs, PATH, PATTERN).collect()) == exp
    assert round_trip(no_docs, PATH, PATTERN).count() == 0
    assert decode(encode(no_docs, PATH, PATTERN), PATH).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [None, 0]), (3, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in decode(odd, PATH).orderBy("doc_id").collect()] == [b"", TOKENS[0], b""]


def test_a_text_beyond_a_chunk(spark):
    long = " ".join(f"word{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, "x"), (2, long), (3, "y")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode(df, PATH, PATTERN).collect()}
    assert got == {1: LIBRARY.encode_ordinary("x"), 2: LIBRARY.encode_ordinary(long), 3: LIBRARY.encode_ordinary("y")}


def test_query(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op12(spark, sf_small).collect())
    assert got == sorted((r.doc_id, *_expected(r.text)) for r in docs)
