"""Registered queries that write to the stores and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..session import ensure_checkpoint_dir
from ..sources import derived as D
from ..sources import store
from ..sources.merge_store import MergeStore
from ..streaming import state_tables as ST
from .registry import register
from .sqlviews import with_views


def _root(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("content_readback", "A4,A5,M1", sql=with_views("d_chain") + """
, v AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY seq DESC, id DESC) AS rn FROM d_chain)
SELECT 'domains/site_' || page_id || '/jobs/latest/pages/index_raw.md' AS path, text AS content FROM v WHERE rn = 1 AND n > 1""")
def q_content_readback(spark, sf):
    """Pages' texts in a store: the first version of every page, then the latest of
    those with several (a batch that is replayed), then pages of one version are
    removed; compacted, and read back."""
    chain = D.version_chain(spark, sf)
    per_page = chain.groupBy("page_id").agg(F.min(F.struct("seq", "id", "text")).alias("first"), F.max(F.struct("seq", "id", "text")).alias("last"))
    path = F.concat(F.lit("domains/site_"), "page_id", F.lit("/jobs/latest/pages/index_raw.md")).alias("path")
    several = F.col("first.id") != F.col("last.id")
    root = _root(spark, "content")
    latest = per_page.where(several).select(path, F.col("last.text").alias("content"))
    store.upsert_content(spark, per_page.select(path, F.col("first.text").alias("content")), root, "first")
    store.upsert_content(spark, latest, root, "latest")
    store.delete_content(spark, per_page.where(~several).select(path), root, "gone")
    store.upsert_content(spark, latest, root, "latest")
    store.content_store(spark, root).compact(everything=True)
    return store.read_content(spark, root)


@register("version_append_readback", "A7,M1", sql=with_views("d_chain") + """
SELECT id, page_id, seq, CASE WHEN seq = min(seq) OVER (PARTITION BY page_id) THEN 'first' ELSE 'later' END AS batch FROM d_chain""")
def q_version_append_readback(spark, sf):
    """Version rows appended in two batches, the second one twice (a retried job)."""
    chain = D.version_chain(spark, sf).select("id", "page_id", "seq")
    first = chain.groupBy("page_id").agg(F.min("seq").alias("f"))
    marked = chain.join(first, "page_id").withColumn("new", F.col("seq") == F.col("f")).drop("f")
    root = _root(spark, "versions")
    for batch, new in (("first", True), ("later", False), ("later", False)):
        store.append_versions(marked.where(F.col("new") == new).drop("new"), root, batch)
    return spark.read.parquet(root).select("id", "page_id", "seq", "batch")


@register("artifact_store_after_prune", "E7,R3", sql=with_views("d_job", "d_artifact") + """
, h AS (SELECT a.id, row_number() OVER (PARTITION BY a.domain_id, a.kind ORDER BY j.finished_at DESC NULLS FIRST, a.created_at DESC, a.id DESC) AS rank
        FROM d_artifact a JOIN d_job j ON a.job_id = j.id WHERE j.status = 'finished')
SELECT a.id, a.domain_id, a.kind, a.version FROM d_artifact a LEFT JOIN h ON h.id = a.id WHERE coalesce(h.rank, 1) <= 5""")
def q_artifact_store_after_prune(spark, sf):
    """The artifact rows in a store, those beyond the retention removed from it."""
    artifacts = D.artifacts(spark, sf)
    rows = artifacts.select("id", "domain_id", "kind", F.col("version").cast("int").alias("version"))
    s = MergeStore(spark, _root(spark, "artifacts"), rows.schema, ["id"])
    s.upsert(rows, "all")
    s.delete(C.retention_prune(artifacts, D.jobs(spark, sf), keep=5)[1].select("id"), "pruned")
    return s.read()


@register("job_stats_incremental", "D1,D2,D6,D10", sql=with_views("d_version") + """
SELECT job_id, count(*) AS total, count(*) FILTER (WHERE importance IS NULL OR importance >= 2) AS changed, count(*) FILTER (WHERE importance < 2) AS skipped,
       avg(importance) AS average_importance, count(DISTINCT page_id) AS approx_pages, count(DISTINCT page_id) AS unique_pages
FROM d_version GROUP BY job_id""")
def q_job_stats_incremental(spark, sf):
    """Per-job counts, mean score and distinct pages (sketched and exact) from three
    batches of versions, the second one replayed. A job's pages are so few that
    the sketch is exact."""
    v = D.page_versions(spark, sf).select("job_id", "page_id", "importance")
    path = _root(spark, "job-stats")
    run = ST.stats_batches(path)
    for batch, part in ((0, F.col("importance").isNull()), (1, F.col("importance") < 3), (2, F.col("importance") >= 3), (1, F.col("importance") < 3)):
        run(v.where(part), batch)
    return ST.read_stats(spark, path, exact=True)
