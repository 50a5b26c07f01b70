"""Scan against Python's own regular expressions; trigram queries; edge cases."""

import random
import re

from sitegrove.llm.secret_scan import ALWAYS, RULES, candidates, scan, trigram_query
from sitegrove.llm.common import doc_key

BASE = {"assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}


def brute(text):
    out = []
    for rank, r in enumerate(RULES):
        pattern, group, least = BASE.get(r.kind, (r.pattern, r.group, r.min_chars))
        out += [(m.start(), rank, m.end(), r.kind) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(out)


def test_matches_python(spark):
    rnd = random.Random(11)
    bits = ["password", "Token: ", "SECRET = '", "api_key=", "apikey\"", "passwd", ": ", "=", "'", " ", "AKIA", "ABCDEFGH12345678", "deadbeef" * 5, "0123456789abcdef" * 2,
            "abcdefgh", "x", "é", "😀", "\n", "ghp_" + "a1" * 20, "xoxb-1234567890", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "token=token=abcdefgh"]
    docs = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))) for i in range(1200)]
    got = {r.row.doc_id: [(s.start, s.rank, s.end, s.kind) for s in r.spans] for r in scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        assert got[i] == brute(t), t


def test_trigram_queries():
    assert trigram_query(r"[0-9a-f]{32,}") == ALWAYS and trigram_query("ab") == ALWAYS and trigram_query("(abc)?x") == ALWAYS
    assert trigram_query("abcd") == {frozenset(["abc", "bcd"])}
    assert trigram_query("abc|xyz") == {frozenset(["abc"]), frozenset(["xyz"])}
    assert trigram_query("ab[cd]e+") == {frozenset(["abc"]), frozenset(["abd"])}
    assert trigram_query("ABC.*def") == {frozenset(["abc", "def"])}


def test_queries_lose_no_match(spark):
    docs = [(1, "my Api_Key = abcdefgh1"), (2, "nothing here"), (3, "AKIA" + "Z" * 12), (4, "xoxb-aaaaaaaaaa")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = candidates(df, RULES).join(df.select("doc_id", *doc_key()), ["k1", "k2"])
    assert {(r.doc_id, k) for r in found.collect() for k in r.rules} == {(1, "assign"), (3, "access"), (4, "slack")}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = scan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.spans == [] for r in rows)
    assert scan(no_docs).count() == 0
    many = "token=abcdefgh " * 5000
    r = scan(spark.createDataFrame([(1, many), (1, many)], "doc_id long, text string")).collect()
    assert [len(x.spans) for x in r] == [5000, 5000] and r[0].spans[-1].end == len(many) - 1
