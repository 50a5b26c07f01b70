"""Aggregates kept up micro-batch by micro-batch in stored tables (D1, D2, D6,
D10, S6).

Each ``foreachBatch`` function reduces its batch to partial states and writes only
those, under a token of the batch id: a replayed batch replaces its own partial
states, so nothing is counted twice. Reading merges the partial states of a job:
counts and sums add up, distinct pages are sketches that are united (or, exactly,
keys of a table where the same page is one row), closes are the least time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import changed, skipped
from ..operators.jobstate import close_bookkeeping
from ..sources.merge_store import MergeStore

STATS = "job_id long, batch long, total long, changed long, skipped long, scored long, score_sum long, pages binary"
SKETCH_BITS = 14  # relative error of a large distinct count: 1.04 / sqrt(2^14), 0.8 %


def partial_stats(versions: DataFrame) -> DataFrame:
    """Mergeable state of a job's versions (job_id, page_id, importance)."""
    return versions.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(changed()).alias("changed"), F.count_if(skipped()).alias("skipped"),
        F.count("importance").alias("scored"), F.coalesce(F.sum("importance"), F.lit(0)).cast("long").alias("score_sum"),
        F.hll_sketch_agg("page_id", F.lit(SKETCH_BITS)).alias("pages"))


def merge_stats(parts: DataFrame) -> DataFrame:
    """(job_id, total, changed, skipped, average_importance, approx_pages)."""
    m = parts.groupBy("job_id").agg(*[F.sum(c).alias(c) for c in ("total", "changed", "skipped", "scored", "score_sum")],
                                    F.hll_sketch_estimate(F.hll_union_agg("pages")).alias("approx_pages"))
    return m.select("job_id", "total", "changed", "skipped", F.when(F.col("scored") > 0, F.col("score_sum") / F.col("scored")).alias("average_importance"),
                    F.coalesce("approx_pages", F.lit(0)).alias("approx_pages"))


def _stats_table(spark: SparkSession, path: str) -> MergeStore:
    return MergeStore(spark, f"{path}/stats", STATS, ["job_id", "batch"], ["job_id"])


def _page_table(spark: SparkSession, path: str) -> MergeStore:
    return MergeStore(spark, f"{path}/pages", "job_id long, page_id long", ["job_id", "page_id"], ["job_id"])


def stats_batches(path: str, fanout: int = 8):
    """``foreachBatch`` over (job_id, page_id, importance)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark, token = batch.sparkSession, f"batch-{batch_id}"
        stats, pages = _stats_table(spark, path), _page_table(spark, path)
        stats.upsert(partial_stats(batch).withColumn("batch", F.lit(batch_id).cast("long")), token)
        pages.upsert(batch.select("job_id", "page_id").where("page_id IS NOT NULL").distinct(), token)
        stats.compact(fanout)
        pages.compact(fanout)
    return run


def read_stats(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    """``merge_stats`` of all batches; ``exact`` adds unique_pages."""
    out = merge_stats(_stats_table(spark, path).read())
    if not exact:
        return out
    pages = _page_table(spark, path).read().groupBy("job_id").agg(F.count(F.lit(1)).alias("unique_pages"))
    return out.join(pages, "job_id", "left").withColumn("unique_pages", F.coalesce("unique_pages", F.lit(0)))


def _event_table(spark: SparkSession, path: str) -> MergeStore:
    return MergeStore(spark, path, "job_id long, ts timestamp_ntz, kind int, batch long, n long", ["job_id", "ts", "kind", "batch"], ["job_id"])


def close_batches(path: str, fanout: int = 8):
    """``foreachBatch`` over (job_id, ts, kind), kind 1 received, 2 processed, 3
    closed. What is counted at a close is known only when the least close time is,
    and late events count by their time: the table keeps counts by job and time."""
    def run(batch: DataFrame, batch_id: int) -> None:
        table = _event_table(batch.sparkSession, path)
        counts = batch.groupBy("job_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("kind").cast("int").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
        table.upsert(counts.withColumn("batch", F.lit(batch_id).cast("long")), f"batch-{batch_id}")
        table.compact(fanout)
    return run


def read_closes(spark: SparkSession, path: str, existing_stats: DataFrame | None = None) -> DataFrame:
    """The close bookkeeping of everything that has come so far."""
    return close_bookkeeping(_event_table(spark, path).read(), existing_stats)
