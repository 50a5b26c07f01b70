"""Prefix join against a direct search for windows; edge cases."""

import random
import re

from sitegrove.llm.decontaminate import contamination


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, window=10):
    wins = {}
    for item, t in items:
        w = words(t)
        if w and item is not None:
            for i in range(max(1, len(w) - window + 1)):
                wins.setdefault(tuple(w[i:i + window]), set()).add(item)
    sizes = {len(w) for w in wins}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                own = wins.get(tuple(w[p:p + n]))
                if own:
                    hit |= set(range(p, p + n))
                    found |= own
        out.append((i, len(w), len(hit), tuple(sorted(map(str, found)))))
    return sorted(out, key=str)


def run(docs, items, **kw):
    return sorted(((r.row.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in contamination(docs, items, **kw).collect()), key=str)


def test_matches_direct_search(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(6)] + ["Über", "x9"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 2, 3, 9, 10, 11, 14])))) for i in range(30)]
    items += [(100, items[5][1]), (None, "w1"), (101, None)]
    docs = []
    for i in range(120):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(0, 30))]
        if i % 3 == 0:
            t += words(rnd.choice(items)[1])
        docs.append((i, ", ".join(t).upper() if i % 2 else " ".join(t)))
    items = [x for x in items if len(words(x[1])) not in (1, 2)] + [(200, "x9 w1"), (201, "Über")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    exp = brute(docs, items)
    assert run(d, b) == exp
    assert run(d, b, broadcast_rows=0) == exp  # the shuffled joins


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "a long line number"), (1, "ünïcödé ßtraße"), (2, ""), (3, None)], "item_id long, text string")
    got = {(r.row.doc_id, r.row.n_chars): (r.n_words, r.n_hit, r.item_ids) for r in contamination(odd_docs, items).collect()}
    assert got[(4, None)] == (0, 0, []) and got[(3, 0)] == (0, 0, []) and got[(5, 9)] == (6000 * 15, 6000 * 4, ["1"]) and got[(9, 3)][1:] == (0, [])
    assert contamination(odd_docs, items).count() == odd_docs.count()
    assert contamination(no_docs, items).count() == 0
    assert contamination(odd_docs, items.limit(0)).where("n_hit > 0").count() == 0
