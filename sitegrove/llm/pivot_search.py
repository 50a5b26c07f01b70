"""Exact top-k inner products by pivot-table elimination.

Vectors are lengthened to one common norm by an extra component (0 for queries),
so that the largest inner product is the smallest distance. A table holds every
vector's distances to a fixed set of pivots; for a query, the largest difference
between its own and a vector's pivot distances is a lower bound of their distance.
Vectors are evaluated in the order of that bound, until it says that nothing
unevaluated can reach the k-th best score. Scores are exact integers; bounds get a
margin far above their rounding error, and stopping is strict, so ties are kept.

Vectors are dealt into blocks of a bounded number of rows. Each block of queries
meets each block of vectors in a task of its own, which returns at most k rows a
query; the rest is one more top-k over those. Pivots come from a bounded sample
(``sample_rows`` rows with the smallest hashes of their numbers, farthest first);
every vector is indexed, and a poor sample costs time, not exactness.

Defined results: rows with a null id, a null vector, or null or non-finite
components take no part; an empty vector is all zeros, and so are the missing
components of a shorter one; rows that share an id are rows of their own, as
candidates and as queries (each with its own k results); components are floors of ``scale`` times the value, held to the
range of a long, and so are scores; with fewer candidates than k all are returned;
an empty table gives no rows; only the two columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import query, table, write_out

LONG_MAX = (1 << 63) - 1


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): the rows that take part; an id may have several."""
    d = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    d = d.where(F.col("id").isNotNull() & F.col("x").isNotNull() & finite)
    return d.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(vectors: pa.Array, dim: int, exact: bool) -> np.ndarray:
    """Rows padded with zeros; Python integers where doubles would not be exact."""
    size = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), dim))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if not exact:
        out = out.astype(object)
        out[:] = 0
        flat = flat.astype(object)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _lift(m: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - (m.astype(float) ** 2).sum(1), 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Row numbers, each farthest from those before it."""
    if not len(sample):
        return np.zeros(0, int)
    best, chosen = np.full(len(sample), np.inf), [0]
    while len(chosen) < min(n, len(sample)):
        best = np.minimum(best, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if best.max() <= 0:
            break
        chosen.append(int(best.argmax()))
    return np.array(chosen)


def pivot_distances(m: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    m = m.astype(float)
    square = (m ** 2).sum(1)[:, None] + (pivots ** 2).sum(1) - 2 * m @ pivots.T + (lift[:, None] - pivot_lift) ** 2
    return np.sqrt(np.maximum(square, 0))


def search_block(ids: np.ndarray, rids: np.ndarray, m: np.ndarray, table: np.ndarray, qrid: np.ndarray, q: np.ndarray, qtable: np.ndarray,
                 floor: np.ndarray, top: float, k: int, step: int = 256) -> tuple[list, int]:
    """([(query row, id, row, score)], vectors evaluated). floor: a score that each
    query's k-th best is known to reach. Ties go to the smaller id, then row."""
    found, evaluated = [], 0
    for i in range(len(qrid)):
        low = np.abs(table - qtable[i]).max(1) if table.shape[1] else np.zeros(len(ids))
        reach = (float((q[i].astype(float) ** 2).sum()) + top) / 2
        bound = reach - low ** 2 / 2 + 1e-6 * reach + 1e-3  # no score is above it
        order = np.argsort(-bound, kind="stable")
        order = order[rids[order] != qrid[i]]
        least, held, best = floor[i], np.zeros(0, np.int64), np.zeros(0, m.dtype)
        for at in range(0, len(order), step):
            if bound[order[at]] < least:
                break
            rows = order[at:at + step]
            evaluated += len(rows)
            held, best = np.concatenate([held, rows]), np.concatenate([best, m[rows] @ q[i]])
            if len(best) > k:
                keep = (np.lexsort((rids[held], ids[held], -best))[:k] if m.dtype != object
                        else sorted(range(len(best)), key=lambda j: (-best[j], ids[held[j]], rids[held[j]]))[:k])
                held, best = held[keep], best[keep]
                least = max(least, best[-1])
        found += [(int(qrid[i]), int(ids[a]), int(rids[a]), max(-LONG_MAX - 1, min(LONG_MAX, int(b)))) for a, b in zip(held, best)]
    return found, evaluated


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 32, sample_rows: int = 4096,
                block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """vectors: (id, v). (query_id, rank, id, score) of the k best other rows of
    each query row, ties to the smaller id. Rows have a number of their own, so
    rows that share an id are candidates, and queries, each for itself."""
    vectors = write_out(vectors.select("id", "v", is_query.alias("asks")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    s = vectors.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q"), F.max(F.size("v")).alias("dim"), F.max(norm).alias("top")).first()
    dim, top, exact = max(s["dim"] or 0, 1), s["top"] or 0.0, (s["top"] or 0.0) < 2.0 ** 51
    n_c, n_q = max(1, -(-s["n"] // block_rows)), max(1, -(-(s["q"] or 0) // query_rows))

    sample = vectors.orderBy(F.xxhash64(F.lit("pivot"), "rid"), "rid").limit(sample_rows).select("rid", "v").toArrow()
    sample_m = _matrix(sample.column("v").combine_chunks(), dim, exact) if len(sample) else np.zeros((0, dim))
    lift = _lift(sample_m, top)
    chosen = choose_pivots(np.column_stack([sample_m.astype(float), lift]), pivots)
    p_exact, p_rids = sample_m[chosen], sample.column("rid").to_numpy()[chosen] if len(sample) else np.zeros(0, np.int64)
    p, p_lift = p_exact.astype(float), lift[chosen]

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1), dim, exact)
            d = pivot_distances(m, _lift(m, top), p, p_lift)
            cells = pa.ListArray.from_arrays(np.arange(0, d.size + 1, max(d.shape[1], 1), dtype=np.int32)[:len(m) + 1], pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), cells], names=["id", "v", "asks", "rid", "far"])

    # the pivot table, written once; blocks are dealt by a hash of the row number
    store = write_out(vectors.mapInArrow(tabled, "id long, v array<long>, asks boolean, rid long, far array<double>"), "pivot-table")
    c = store.select(F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), F.pmod(F.xxhash64("rid"), F.lit(n_c)).cast("int").alias("cb"), "id", "rid", "v", "far")
    q = store.where("asks").select(F.pmod(F.xxhash64(F.lit("q"), "rid"), F.lit(n_q)).cast("int").alias("qb"),
                                   F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"), "rid", "v")

    def block(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list = []
        if len(queries) and len(rows):
            m, ids, rids = _matrix(rows.column("v").combine_chunks(), dim, exact), rows.column("id").to_numpy(), rows.column("rid").to_numpy()
            far = rows.column("far").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(m), -1)
            asked, qrid = _matrix(queries.column("v").combine_chunks(), dim, exact), queries.column("rid").to_numpy()
            qfar = pivot_distances(asked, np.zeros(len(asked)), p, p_lift)
            # the k-th best score among the pivots, which are candidates too
            among = np.where(qrid[:, None] == p_rids, -np.inf, (asked @ p_exact.T).astype(float))
            floor = np.sort(among, 1)[:, -k] if among.shape[1] >= k else np.full(len(qrid), -np.inf)
            out, _ = search_block(ids, rids, m, far, qrid, asked, qfar, floor, top, k)
        a = list(zip(*out)) or [(), (), (), ()]
        return pa.table([pa.array(x, pa.int64()) for x in a], names=["qrid", "id", "rid", "score"])

    best = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(block, "qrid long, id long, rid long, score long")
    rank = F.row_number().over(Window.partitionBy("qrid").orderBy(F.desc("score"), "id", "rid"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    asked_by = store.where("asks").select(F.col("rid").alias("qrid"), F.col("id").alias("query_id"))
    return ranked.join(asked_by, "qrid").select("query_id", "rank", "id", "score")


@query("op8_pivot_table", """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.rid AS crid, c.vec_id, CAST(list_sum(list_transform(range(1, len(c.x) + 1), lambda i: c.x[i] * q.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, crid) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
