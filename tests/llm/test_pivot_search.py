"""Exact search against all inner products; edge cases."""

import math
import random

from pyspark.sql import functions as F

from sitegrove.llm.pivot_search import exact_top_k, integer_vectors


def brute(rows, k):
    """Every row for itself, also where an id repeats."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, w) in enumerate(kept):
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(w, v)), i) for j, (i, v) in enumerate(kept) if j != at)[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in exact_top_k(integer_vectors(df), F.col("id") % 50 == 0, **kw).collect())


def test_matches_all_products(spark):
    rnd = random.Random(1)
    rows = [(i, [float(round(rnd.gauss(0, 1) * 4) / 4) for _ in range(6)]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # a third alike: ties
    assert run(spark, rows, block_rows=150, query_rows=5, pivots=8) == brute(rows, 5)
    assert run(spark, rows) == brute(rows, 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 0.0]), (200, [float("inf"), 0.0]), (None, [1.0, 1.0]), (1, [0.5]), (2, []), (3, [1.0, 2.0]),
            (3, [1.0, 2.0]), (250, [-1.0, -1.0]), (250, [-2.0, 1.0])]
    assert run(spark, rows) == brute(rows, 5)
    twice = [(0, [1.0, 1.0]), (0, [2.0, 1.0]), (7, [1.0, 0.0]), (7, [0.0, 3.0]), (50, [1.0, 1.0])]
    assert run(spark, twice) == brute(twice, 5) and len(run(spark, twice)) == 12
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == [] and run(spark, [(50, []), (51, [])]) == [(50, 1, 51, 0)]
    big = [(0, [1e12, 2.0]), (1, [3e11, 1.0]), (2, [-5.0, 1e12])]
    assert run(spark, big)[0][2] == 1


def test_extra_columns_and_sql(spark, sf_small):
    """Other columns may have the operator's own names; the query's SQL on rows that repeat an id."""
    import duckdb

    from sitegrove.llm.pivot_search import op8
    from sitegrove.llm.queries import QUERIES
    rows = [(0, [1.0, 2.0], 7), (0, [2.0, 2.0], 8), (3, [1.0, 0.0], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rid long").withColumns({c: F.lit(1) for c in ("id", "v", "far", "asks", "qb")})
    assert sorted(tuple(r) for r in exact_top_k(integer_vectors(df), F.col("id") % 50 == 0).collect()) == brute([r[:2] for r in rows], 5)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings AS SELECT * FROM (VALUES (0, [1.0, 2.0]), (0, [2.0, 2.0]), (3, [1.0, 0.0])) t(vec_id, embedding)")
    assert sorted(con.execute(QUERIES["op8_pivot_table"][1]).fetchall()) == brute([r[:2] for r in rows], 5)
    assert op8(spark, sf_small).count() > 0
