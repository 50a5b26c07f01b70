"""Line diff (G2/G4) against a dynamic-programming LCS; quirks Q5, Q19; score
parsing (G8); similarity (G10)."""

import random

from pyspark.sql import functions as F

from sitegrove.operators import changes as G


def _dp_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def _brute(old, new):
    ta, tb = G._tokens(old), G._tokens(new)
    lcs = _dp_lcs(ta, tb)
    u = lcs - (1 if ta and tb and ta[-1] == tb[-1] else 0)
    return new.count("\n") - u, old.count("\n") - u, u


def test_line_diff_matches_dp_lcs():
    rnd = random.Random(7)
    vocab = ["a", "b", "c", "", "d e", "  "]
    for _ in range(2000):
        old = "\n".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 14))).strip()
        new = "\n".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 14))).strip()
        a, d, u, text = G.line_diff(old, new, True)
        assert (a, d, u) == _brute(old, new)
        # the rendered hunks hold every token of both sides once
        body = text.replace("+ ", "").replace("- ", "").replace("  ", "")
        assert len(body) <= len(old) + len(new) + 2


def test_last_line_only_edit_is_no_change():  # Q5
    assert G.line_diff("a\nb", "a\nc")[:3] == (0, 0, 1)
    assert G.line_diff("a\nb\nc", "a\nx\nc")[:3] == (1, 1, 1)


def test_diff_versions_in_spark(spark):
    rows = [(1, None, "x"), (2, "a\nb\nc", "a\nb\nc"), (3, "a\nb\nc", "a\nx\nc"), (4, "a\r\nb", "a\nb"),
            (5, "", "new\ntext")]
    df = spark.createDataFrame(rows, "id long, old string, new string")
    out = {r.id: r for r in G.diff_versions(df, "old", "new").collect()}
    assert out[1].has_changes is None
    assert (out[2].additions, out[2].deletions, out[2].unchanged, out[2].has_changes) == (0, 0, 2, False)
    assert (out[3].additions, out[3].deletions, out[3].change_percentage) == (1, 1, 2 / 3 * 100)  # (changed / total) * 100, as computed there
    assert out[4].has_changes is False            # CRLF normalised (G1)
    assert (out[5].additions, out[5].deletions) == (1, 0)


def test_score_parsing(spark):
    vals = [" 3 ", "4", "1", "2 (moderate)", "high", "9", None, "-1", "0", "+4", "3.7"]
    df = spark.createDataFrame([(v,) for v in vals], "r string")
    got = [r.s for r in df.select(G.parse_score(F.col("r")).alias("s")).collect()]
    assert got == [3, 4, 1, 2, 2, 2, 2, 2, 2, 4, 3]


def test_similarity_edges(spark):  # G10, Q19
    df = spark.createDataFrame([("a b", "a b"), ("", "x"), ("  ", " \t"), ("a b c d", "a b c e")], "a string, b string")
    got = [r.s for r in df.select(G.similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == 1.0
    assert abs(got[3] - (0.3 * 1.0 + 0.7 * 3 / 5)) < 1e-12
    changed, reason = G.changed_enough(F.lit(0.9), F.lit(0.95))
    r = spark.range(1).select(changed.alias("c"), reason.alias("r")).first()
    assert r.c is True and r.r == "Content changed by 10%"


def test_change_decision(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1, False), (3, 1, True), (4, 1, None)],
                               "id long, prev_id long, has_changes boolean")
    out = {r.id: (r.importance, r.reason) for r in G.change_decision(df, F.lit(1)).collect()}
    assert out[1] == (4, "New page")
    assert out[2] == (None, "No changes detected in diff")
    assert out[3] == (1, "Semantic importance: 1/4")
    assert out[4] == (2, "No diff available")


def test_previous_version_equals_lag(spark):
    """Duplicate numbers, gaps, any type of order, and a page that holds a third
    of all rows, as one window and as a globally ordered key."""
    from pyspark.sql import Window
    rows = [(1, 0, 10, "a"), (1, 0, 11, "b"), (1, 0, 12, None), (1, 5, 13, "c"), (2, 0, 20, "x"), (3, 3, 30, "p"), (3, 1, 31, "q")]
    rows += [(9, i // 3, 1000 - i, f"t{i}") for i in range(300)] + [(100 + i % 200, i, i, f"s{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, seq long, id long, text string")
    for order in (["seq", "id"], ["name", "id"]):
        d = df.withColumn("name", F.format_string("%05d", "seq"))
        w = Window.partitionBy("page_id").orderBy(*order)
        exp = d.withColumn("prev_id", F.lag("id").over(w)).withColumn("prev_text", F.lag("text").over(w))
        for task_rows in (10_000, 100, 1):
            got = G.previous_version(d, "page_id", order, ["id", "text"], task_rows=task_rows)
            assert got.count() == len(rows)
            assert got.select(*exp.columns).exceptAll(exp).count() == 0


def test_common_lines_are_a_longest_subsequence():
    rnd = random.Random(11)
    for size, kinds in ((12, 5), (40, 3), (30, 25)):
        for _ in range(700):
            a = [rnd.randrange(kinds) for _ in range(rnd.randint(0, size))]
            b = [rnd.randrange(kinds) for _ in range(rnd.randint(0, size))]
            pairs = G._common(a, b)
            assert all(a[i] == b[j] for i, j in pairs)
            assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
            assert len(pairs) == _dp_lcs(a, b)


def test_hunks_rebuild_both_sides():
    """Unprefixed and '- ' hunks are the old text, unprefixed and '+ ' ones
    the new text (marks are not in the vocabulary)."""
    import re
    rnd = random.Random(12)
    for _ in range(500):
        old, new = ("\n".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12))) for _ in range(2))
        hunks = re.findall(r"(  |- |\+ )((?:[abcd]\n?)+)", G.line_diff(old, new, True)[3])
        assert "".join(t for m, t in hunks if m != "+ ") == old
        assert "".join(t for m, t in hunks if m != "- ") == new


def test_unlike_long_texts_are_fast():
    import time
    old, new = ("\n".join(f"{side} line {i}" if i % 7 else "same" for i in range(20_000)) for side in "xy")
    t0 = time.process_time()
    a, d, u, _ = G.line_diff(old, new)
    assert u == 2857 and a == d == 19_999 - u and time.process_time() - t0 < 1


def test_diff_runs_once_per_row(spark):
    rows = [(1, "a\nb\nc", "a\nx\nc"), (2, None, "x")]
    d = G.diff_versions(spark.createDataFrame(rows, "id long, old string, new string"), "old", "new").filter("has_changes")
    assert d._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.id for r in d.collect()] == [1]


def test_time_ordered_previous_version_equals_lag(spark):
    rows = [(1, "2024-01-01 00:00:00", 10, "a"), (1, "2024-01-03 00:00:00", 11, "b"), (1, "2024-01-03 00:00:00", 12, "c"),
            (1, "2024-02-09 00:00:00", 13, "d"), (2, "2023-05-01 00:00:00", 20, "x")]
    df = spark.createDataFrame(rows, "page_id long, created_at string, id long, text string") \
        .withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    from pyspark.sql import Window
    got = G.previous_version(df, "page_id", ["created_at", "id"], ["id", "text"])
    w = Window.partitionBy("page_id").orderBy("created_at", "id")
    exp = df.withColumn("prev_id", F.lag("id").over(w)).withColumn("prev_text", F.lag("text").over(w))
    assert got.count() == 5
    assert got.select(*exp.columns).exceptAll(exp).count() == 0


def test_diff_text_has_one_form():
    """The walk over the full table of suffix lengths, in Python and in SQL."""
    import duckdb
    from sitegrove.plans.q_changes import _diff_text_sql
    rnd, rows = random.Random(12), []
    for i in range(400):
        a, b = ([rnd.choice("abcd") + "\n" for _ in range(rnd.randint(0, 9))] + ([rnd.choice("abx")] if rnd.random() < 0.6 else []) for _ in range(2))
        rows.append((i, a, b))
        n, m = len(a), len(b)
        table = [[0] * (m + 1) for _ in range(n + 1)]
        for p in range(n - 1, -1, -1):
            for q in range(m - 1, -1, -1):
                table[p][q] = table[p + 1][q + 1] + 1 if a[p] == b[q] else max(table[p + 1][q], table[p][q + 1])
        pairs, j = [], 0
        for p in range(n):
            q = next((q for q in range(j, m) if b[q] == a[p]), None)
            if q is not None and 1 + table[p + 1][q + 1] == table[p][j]:
                pairs.append((p, q))
                j = q + 1
        assert G._common(a, b) == pairs and G._common_length(a, b) == len(pairs)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id INT, ta VARCHAR[], tb VARCHAR[])")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    got = dict(con.execute(f"SELECT id, {_diff_text_sql('ta', 'tb')} FROM t").fetchall())
    assert got == {i: G.line_diff("".join(a), "".join(b), True)[3] for i, a, b in rows}


def test_long_texts_in_little_memory():
    rnd = random.Random(7)
    a = [rnd.randint(0, 40) for _ in range(6000)]
    b = [t for t in a if rnd.random() < 0.9] + [41] * 5
    pairs = G._common(a, b)
    assert len(pairs) == G._common_length(a, b) == len(b) - 5
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
    s = G._Suffixes(a, b)
    s.length(3001, 0)
    assert len(s.kept) + len(s.block) < 200


def test_counts_of_lines(spark):
    pairs = [("a\nb", "a\nc"), ("a\nb", "a\nb"), ("", "x"), ("", ""), (None, "x"), ("a\nb\nc", "c"), ("one", "one\n")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, o string, n string")
    got = {r.id: (r.additions, r.deletions, r.unchanged, r.has_changes) for r in G.diff_versions(df, "o", "n", count="lines").collect()}
    assert got == {0: (1, 1, 1, True), 1: (0, 0, 2, False), 2: (1, 0, 0, True), 3: (0, 0, 0, False), 4: (None, None, None, None),
                   5: (0, 2, 1, True), 6: (0, 0, 1, False)}
