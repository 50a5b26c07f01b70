"""Line runs against a direct count; edge cases."""

import random
from collections import Counter, defaultdict

from sitegrove.llm.line_dedup import dedup_lines

BLANKS = " \t\n\x0b\x0c\r"


def fold(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def brute(docs, min_chars, min_docs):
    """docs: {id: text}"""
    holders = defaultdict(set)
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            holders[fold(line).strip(BLANKS)].add(i)
    hot = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = {}
    for i, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if hot.get(fold(x).strip(BLANKS), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_matches_direct_count(spark):
    rnd = random.Random(3)
    pool = [f"  Shared LINE number {i} with Ärger and enough letters to count {i}\t" for i in range(12)] + ["short", "", "  "]
    docs = {i * 3: "\n".join(rnd.choice(pool + [f"own line {i} {rnd.random()} which nobody else has at all"]) for _ in range(rnd.randint(0, 9)))
            for i in range(150)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for batches, fan_out in ((1, 2), (4, 2), (7, 3)):
        got = {r.row.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(df, batches=batches, fan_out=fan_out).collect()}
        assert got == brute(docs, 40, 5)


def test_every_batch_count_gives_the_same_answer_for_few_documents(spark):
    text = "The very same line of more than forty characters, in five documents."
    df = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")
    got = {r.row.doc_id: r.kept_text for r in dedup_lines(df, batches=3).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "", 4: text}


def test_odd_rows(odd_docs, no_docs):
    rows = dedup_lines(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = Counter((r.row.doc_id, r.n_lines, r.n_dropped) for r in rows)
    assert by[(3, 1, 0)] == 1 and by[(4, 1, 0)] == 1 and by[(None, 1, 0)] == 2 and by[(6, 3, 0)] == 1 and by[(2, 1, 0)] == 2
    assert by[(5, 6000, 0)] == 1
    assert set(rows[0].row.asDict()) == set(odd_docs.columns)
    assert dedup_lines(no_docs).count() == 0
