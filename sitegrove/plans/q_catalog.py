"""Registered catalog queries (B, C, D, E, R) with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import AS_OF
from ..operators import catalog as C
from ..sources import derived as D
from ..sources import store
from .registry import register
from .sqlviews import with_views

def _flat(col: str, fields: list[str], name: str):
    """A nested list column as one text value: entries joined by ';', fields
    by ':' (NULL as empty) -- the same text in both engines, so the check
    compares plain strings rather than engine-specific nested values."""
    entry = lambda e: F.concat_ws(":", *[F.coalesce(e[f].cast("string"), F.lit("")) for f in fields])
    return F.array_join(F.transform(col, entry), ";").alias(name)


def _flat_sql(expr: str, fields: list[str]) -> str:
    parts = " || ':' || ".join(f"coalesce(CAST(e.{f} AS VARCHAR), '')" for f in fields)
    return f"array_to_string(list_transform({expr}, lambda e: {parts}), ';')"


_DUR = ("CAST(floor((epoch_ms(coalesce({f}, TIMESTAMP '" + AS_OF + "')) - epoch_ms({s})) / 60000.0 + 0.5) AS BIGINT)")


@register("active_domains_with_profile", "B1,C1", sql=with_views("d_domain", "d_profile") + """
SELECT d.profile_id, d.id, d.domain, d.check_interval_minutes, d.model, d.is_active, d.created_at, d.updated_at,
       p.name AS profile_name, p.summary_prompt, p.version AS profile_version
FROM d_domain d LEFT JOIN d_profile p ON d.profile_id = p.id WHERE d.is_active""")
def q_active_domains(spark, sf):
    return C.active_domains(D.domains(spark, sf), D.profiles(spark, sf))


@register("changed_versions", "B2", sql=with_views("d_version") + """
SELECT * FROM d_version WHERE importance IS NULL OR importance >= 2""")
def q_changed(spark, sf):
    return C.changed_versions(D.page_versions(spark, sf))


@register("skipped_versions", "B3", sql=with_views("d_version") + """
SELECT * FROM d_version WHERE importance < 2""")
def q_skipped(spark, sf):
    return C.skipped_versions(D.page_versions(spark, sf))


@register("failed_jobs_with_domain", "B4", sql=with_views("d_job", "d_domain") + """
SELECT j.domain_id, j.id, j.type, j.status, j.external_id, j.started_at, j.finished_at, d.domain
FROM d_job j JOIN d_domain d ON j.domain_id = d.id WHERE j.status = 'failed'""")
def q_jobs_by_status(spark, sf):
    return C.jobs_by_status(D.jobs(spark, sf), D.domains(spark, sf), "failed")


@register("job_search_1997", "B5", sql=with_views("d_job", "d_domain", "d_version") + f"""
SELECT j.id, d.domain, j.status, j.started_at, j.finished_at,
       coalesce(v.n, 0) AS pages_processed, {_DUR.format(f='j.finished_at', s='j.started_at')} AS duration_minutes,
       CAST(CASE WHEN j.status = 'finished' THEN 100 ELSE least(100, coalesce(v.n, 0)) END AS BIGINT) AS progress_percent
FROM d_job j JOIN d_domain d ON j.domain_id = d.id
LEFT JOIN (SELECT job_id, count(*) AS n FROM d_version GROUP BY job_id) v ON v.job_id = j.id
WHERE j.started_at >= TIMESTAMP '1997-01-01 00:00:00' AND j.started_at < TIMESTAMP '1998-01-01 00:00:00'
  AND j.status = 'processing'""")
def q_job_search(spark, sf):
    return C.job_search(D.jobs(spark, sf), D.page_versions(spark, sf), D.domains(spark, sf), "processing",
                        None, "1997-01-01 00:00:00", "1998-01-01 00:00:00", AS_OF)


@register("domains_with_active_job", "B6", sql=with_views("d_domain", "d_job") + """
SELECT * FROM d_domain d WHERE EXISTS (SELECT 1 FROM d_job j WHERE j.domain_id = d.id AND j.status = 'processing')""")
def q_active_job(spark, sf):
    return C.domains_with_active_job(D.domains(spark, sf), D.jobs(spark, sf))


@register("job_with_versions", "C2", sql=with_views("d_job", "d_domain", "d_version") + """
SELECT j.id, j.domain_id, j.type, j.status, j.external_id, j.started_at, j.finished_at, d.domain,
       """ + _flat_sql("v.versions", ["id", "page_id", "importance", "change_status"]) + """ AS versions
FROM d_job j JOIN d_domain d ON j.domain_id = d.id
LEFT JOIN (SELECT job_id, list_sort(list({'id': id, 'page_id': page_id, 'importance': importance,
                                          'change_status': change_status})) AS versions
           FROM d_version GROUP BY job_id) v ON v.job_id = j.id""")
def q_job_with_versions(spark, sf):
    j = C.job_with_versions(D.jobs(spark, sf), D.domains(spark, sf), D.page_versions(spark, sf))
    return j.withColumn("versions", _flat("versions", ["id", "page_id", "importance", "change_status"], "versions"))


@register("versions_with_page", "C3,E2", sql=with_views("d_version_page") + """
SELECT job_id, page_id, id, url, created_at FROM d_version_page
QUALIFY row_number() OVER (PARTITION BY job_id, page_id ORDER BY created_at DESC, id DESC) = 1""")
def q_versions_with_page(spark, sf):
    v = D.page_versions(spark, sf, with_page=True)
    return C.latest_version_per_page_in_job(v, ["id", "url", "created_at"])


@register("artifacts_with_job_domain", "C4", sql=with_views("d_artifact", "d_job", "d_domain") + """
SELECT a.domain_id, a.job_id, a.id, a.kind, a.version, a.created_at, j.started_at, j.finished_at, j.status, d.domain
FROM d_artifact a JOIN d_job j ON a.job_id = j.id JOIN d_domain d ON a.domain_id = d.id""")
def q_artifacts_joined(spark, sf):
    return C.artifacts_with_job_domain(D.artifacts(spark, sf), D.jobs(spark, sf), D.domains(spark, sf))


@register("profile_usage", "C8", sql=with_views("d_profile", "d_domain") + """
SELECT p.id AS profile_id, p.name, p.version, coalesce(u.n, 0) AS domains_using, u.n IS NULL AS deletable
FROM d_profile p LEFT JOIN (SELECT profile_id, count(*) AS n FROM d_domain
                            WHERE profile_id IS NOT NULL GROUP BY profile_id) u ON u.profile_id = p.id""")
def q_profile_usage(spark, sf):
    return C.profile_usage(D.profiles(spark, sf), D.domains(spark, sf))


@register("version_counts_per_job", "D1", sql=with_views("d_version") + """
SELECT job_id, count(*) AS total,
       count(*) FILTER (WHERE importance IS NULL OR importance >= 2) AS changed,
       count(*) FILTER (WHERE importance < 2) AS skipped
FROM d_version GROUP BY job_id""")
def q_version_counts(spark, sf):
    return C.version_counts(D.page_versions(spark, sf))


@register("final_job_stats", "D2,D10", sql=with_views("d_job", "d_version", "d_artifact") + f"""
SELECT j.id AS job_id, {_DUR.format(f='j.finished_at', s='j.started_at')} AS duration_minutes,
       coalesce(v.total, 0) AS total_pages_processed, coalesce(v.uniq, 0) AS unique_pages,
       coalesce(v.changed, 0) AS changed_pages,
       CASE WHEN v.av <> 0 THEN floor(v.av * 100 + 0.5) / 100 END AS average_importance,
       coalesce(a.n, 0) AS artifacts_generated, 100 AS completion_rate
FROM d_job j
LEFT JOIN (SELECT job_id, count(*) AS total, count(DISTINCT page_id) AS uniq,
                  count(*) FILTER (WHERE importance IS NULL OR importance >= 2) AS changed,
                  avg(importance) AS av FROM d_version GROUP BY job_id) v ON v.job_id = j.id
LEFT JOIN (SELECT job_id, count(*) AS n FROM d_artifact GROUP BY job_id) a ON a.job_id = j.id""")
def q_final_stats(spark, sf):
    return C.final_job_stats(D.jobs(spark, sf), D.page_versions(spark, sf), D.artifacts(spark, sf), AS_OF)


@register("domain_dashboard", "D4,E3", sql=with_views("d_domain", "d_job", "d_version_page") + """
, pc AS (SELECT domain_id, count(DISTINCT page_id) AS page_count FROM d_version_page GROUP BY domain_id)
, lj AS (SELECT domain_id, id, status, started_at FROM d_job
         QUALIFY row_number() OVER (PARTITION BY domain_id ORDER BY started_at DESC, id DESC) = 1)
, vc AS (SELECT job_id, count(*) AS n FROM d_version_page GROUP BY job_id)
SELECT d.id AS domain_id, d.domain, d.updated_at, coalesce(pc.page_count, 0) AS page_count,
       lj.id AS last_job_id, lj.status AS last_job_status, lj.started_at AS last_job_started_at,
       CASE WHEN lj.id IS NOT NULL THEN coalesce(vc.n, 0) END AS last_job_versions
FROM d_domain d LEFT JOIN pc ON pc.domain_id = d.id LEFT JOIN lj ON lj.domain_id = d.id
LEFT JOIN vc ON vc.job_id = lj.id""")
def q_dashboard(spark, sf):
    return C.domain_dashboard(D.domains(spark, sf), D.jobs(spark, sf), D.page_versions(spark, sf, with_page=True),
                              D.page_versions(spark, sf))


@register("domain_detail", "D5,E1", sql=with_views("d_domain", "d_job", "d_version_page") + """
, lv AS (SELECT domain_id, url, id FROM d_version_page
         QUALIFY row_number() OVER (PARTITION BY domain_id, url ORDER BY created_at DESC, id DESC) = 1)
, pg AS (SELECT domain_id, count(*) AS page_count,
                list_sort(list({'url': url, 'latest_version_id': id})) AS pages FROM lv GROUP BY domain_id)
, jc AS (SELECT domain_id, count(*) AS n FROM d_job GROUP BY domain_id)
SELECT d.id AS domain_id, d.domain, coalesce(pg.page_count, 0) AS page_count, coalesce(jc.n, 0) AS job_count,
       """ + _flat_sql("pg.pages", ["url", "latest_version_id"]) + """ AS pages
FROM d_domain d LEFT JOIN pg ON pg.domain_id = d.id LEFT JOIN jc ON jc.domain_id = d.id""")
def q_domain_detail(spark, sf):
    d = C.domain_detail(D.domains(spark, sf), D.jobs(spark, sf), D.page_versions(spark, sf, with_page=True))
    return d.withColumn("pages", _flat("pages", ["url", "latest_version_id"], "pages"))


@register("latest_version_per_page", "E1,M3", sql=with_views("d_version") + """
SELECT page_id, id, job_id, importance, created_at FROM d_version
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY created_at DESC, id DESC) = 1""")
def q_latest_version(spark, sf):
    return C.latest_version_per_page(D.page_versions(spark, sf), ["id", "job_id", "importance", "created_at"])


@register("latest_finished_job_per_domain", "E4", sql=with_views("d_job") + """
SELECT domain_id, id, started_at, finished_at FROM d_job WHERE status = 'finished'
QUALIFY row_number() OVER (PARTITION BY domain_id ORDER BY finished_at DESC NULLS FIRST, id DESC) = 1""")
def q_latest_finished(spark, sf):
    return C.latest_finished_job_per_domain(D.jobs(spark, sf))


_CUR_SQL = with_views("d_job", "d_artifact") + """
, lf AS (SELECT domain_id, id AS job_id FROM d_job WHERE status = 'finished'
         QUALIFY row_number() OVER (PARTITION BY domain_id ORDER BY finished_at DESC NULLS FIRST, id DESC) = 1)
, slots AS (SELECT lf.domain_id, lf.job_id, k.kind FROM lf, (VALUES ('llms_txt'), ('llms_full_txt')) k(kind))
, cur AS (SELECT a.domain_id, a.kind, a.id, a.version, a.created_at FROM d_artifact a
          JOIN lf ON a.domain_id = lf.domain_id AND a.job_id = lf.job_id
          QUALIFY row_number() OVER (PARTITION BY a.domain_id, a.kind ORDER BY a.created_at DESC, a.id DESC) = 1)
SELECT s.domain_id, s.kind, s.job_id, c.id, c.version, c.created_at
FROM slots s LEFT JOIN cur c ON c.domain_id = s.domain_id AND c.kind = s.kind"""


@register("current_artifacts", "E5", sql=_CUR_SQL)
def q_current_artifacts(spark, sf):
    return C.current_artifacts(D.artifacts(spark, sf), D.jobs(spark, sf))


@register("artifact_history", "E6,E9", sql=with_views("d_job", "d_artifact") + """
SELECT a.domain_id, a.kind, a.id, a.job_id, a.version, a.created_at, j.finished_at
FROM d_artifact a JOIN d_job j ON a.job_id = j.id WHERE j.status = 'finished'""")
def q_artifact_history(spark, sf):
    return C.artifact_history(D.artifacts(spark, sf), D.jobs(spark, sf))


@register("artifact_retention", "E7", sql=with_views("d_job", "d_artifact") + """
, h AS (SELECT a.domain_id, a.kind, a.id, a.created_at, j.finished_at,
               row_number() OVER (PARTITION BY a.domain_id, a.kind
                                  ORDER BY j.finished_at DESC NULLS FIRST, a.created_at DESC, a.id DESC) AS rank
        FROM d_artifact a JOIN d_job j ON a.job_id = j.id WHERE j.status = 'finished')
SELECT domain_id, kind, count(*) FILTER (WHERE rank <= 5) AS kept, count(*) FILTER (WHERE rank > 5) AS deleted,
       max(CASE WHEN rank = 5 THEN id END) AS oldest_kept_id
FROM h GROUP BY domain_id, kind""")
def q_retention(spark, sf):
    kept, dropped = C.retention_prune(D.artifacts(spark, sf), D.jobs(spark, sf), keep=5)
    k = kept.groupBy("domain_id", "kind").agg(F.count(F.lit(1)).alias("kept"),
                                             F.max(F.when(F.col("rank") == 5, F.col("id"))).alias("oldest_kept_id"))
    d = dropped.groupBy("domain_id", "kind").agg(F.count(F.lit(1)).alias("deleted"))  # noqa: E501
    return (k.join(d, ["domain_id", "kind"], "left")
             .select("domain_id", "kind", "kept", F.coalesce("deleted", F.lit(0)).alias("deleted"), "oldest_kept_id"))


@register("next_artifact_version", "E8", sql=with_views("d_domain", "d_artifact") + """
SELECT d.id AS domain_id, k.kind, CAST(coalesce(m.mx, 0) + 1 AS INTEGER) AS next_version
FROM d_domain d CROSS JOIN (VALUES ('llms_txt'), ('llms_full_txt')) k(kind)
LEFT JOIN (SELECT domain_id, kind, max(version) AS mx FROM d_artifact GROUP BY domain_id, kind) m
  ON m.domain_id = d.id AND m.kind = k.kind""")
def q_next_version(spark, sf):
    return C.next_artifact_version(D.artifacts(spark, sf), D.domains(spark, sf))


@register("first_pages_per_job", "E11", sql=with_views("d_version_page") + """
, u AS (SELECT DISTINCT job_id, url FROM d_version_page)
, r AS (SELECT job_id, url, row_number() OVER (PARTITION BY job_id ORDER BY url) AS rn FROM u)
SELECT job_id, count(*) AS page_count,
       string_agg(CASE WHEN rn <= 10 THEN '- ' || url END, chr(10) ORDER BY rn) AS first_urls
FROM r GROUP BY job_id""")
def q_first_pages(spark, sf):
    return C.first_pages(D.job_page_versions(spark, sf), 10)


@register("version_history", "E12", sql=with_views("d_version") + """
SELECT page_id, id, created_at, count(*) OVER (PARTITION BY page_id) AS version_count,
       row_number() OVER (PARTITION BY page_id ORDER BY created_at DESC, id DESC) AS version_rank
FROM d_version""")
def q_version_history(spark, sf):
    return C.version_history(D.page_versions(spark, sf))


@register("duplicate_page_urls", "R1", sql=with_views("d_version_page") + """
SELECT domain_id, url, count(*) AS n FROM (SELECT DISTINCT domain_id, url, page_id FROM d_version_page)
GROUP BY domain_id, url HAVING count(*) > 1""")
def q_duplicates(spark, sf):
    pages = D.page_versions(spark, sf, with_page=True).select("domain_id", "url", "page_id").distinct()
    return C.duplicate_keys(pages, ["domain_id", "url"])


@register("orphan_versions", "R2", sql=with_views("d_version", "d_job") + """
SELECT v.* FROM d_version v WHERE v.job_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_job j WHERE j.id = v.job_id)""")
def q_orphans(spark, sf):
    return C.orphans(D.page_versions(spark, sf), "job_id", D.jobs(spark, sf))


@register("orphan_jobs", "R2", sql=with_views("d_job", "d_domain") + """
SELECT j.* FROM d_job j WHERE j.domain_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_domain d WHERE d.id = j.domain_id)""")
def q_orphan_jobs(spark, sf):
    return C.orphans(D.jobs(spark, sf), "domain_id", D.domains(spark, sf))


@register("job_status_view", "D3,D1,J7,E9", sql=with_views("d_job", "d_version", "d_artifact") + """
, c AS (SELECT job_id, count(*) AS total, count(*) FILTER (WHERE importance IS NULL OR importance >= 2) AS changed,
               count(*) FILTER (WHERE importance < 2) AS skipped FROM d_version GROUP BY job_id)
, a AS (SELECT job_id, list({'created_at': created_at, 'id': id, 'kind': kind, 'version': version}
                            ORDER BY created_at DESC, id DESC) AS artifacts FROM d_artifact GROUP BY job_id)
SELECT j.id AS job_id, j.domain_id, j.type, j.status,
       CASE WHEN j.finished_at IS NOT NULL
             AND floor((epoch_ms(j.finished_at) - epoch_ms(j.started_at)) / 1000.0 + 0.5) <> 0
            THEN CAST(CAST(floor((epoch_ms(j.finished_at) - epoch_ms(j.started_at)) / 1000.0 + 0.5) AS BIGINT) AS VARCHAR) || 's'
       END AS duration,
       coalesce(c.total, 0) AS total, coalesce(c.changed, 0) AS changed, coalesce(c.skipped, 0) AS skipped,
       """ + _flat_sql("a.artifacts", ["created_at", "id", "kind", "version"]) + """ AS artifacts
FROM d_job j LEFT JOIN c ON c.job_id = j.id LEFT JOIN a ON a.job_id = j.id""")
def q_job_status(spark, sf):
    v = C.job_status_view(D.jobs(spark, sf), D.page_versions(spark, sf), D.artifacts(spark, sf))
    return v.withColumn("artifacts", _flat("artifacts", ["created_at", "id", "kind", "version"], "artifacts"))


@register("profiles_ordered", "E10", sql=with_views("d_profile") + """
SELECT id, name, version, created_at FROM d_profile ORDER BY version DESC, created_at DESC, id""")
def q_profiles_ordered(spark, sf):
    return C.profiles_ordered(D.profiles(spark, sf))


@register("cascade_delete_failed_jobs", "R3", sql=with_views("d_job", "d_version", "d_artifact") + """
, doomed AS (SELECT id FROM d_job WHERE status = 'failed' AND started_at < TIMESTAMP '1996-01-01 00:00:00')
SELECT (SELECT count(*) FROM d_job WHERE id NOT IN (SELECT id FROM doomed)) AS jobs_left,
       (SELECT count(*) FROM d_version WHERE job_id NOT IN (SELECT id FROM doomed)) AS versions_left,
       (SELECT count(*) FROM d_artifact WHERE job_id NOT IN (SELECT id FROM doomed)) AS artifacts_left,
       (SELECT count(*) FROM doomed) AS jobs_deleted""")
def q_cascade(spark, sf):
    jobs = D.jobs(spark, sf)
    doomed = jobs.filter((F.col("status") == "failed") &
                         (F.col("started_at") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))).select("id")
    left = C.cascade_delete_jobs(jobs, D.page_versions(spark, sf), D.artifacts(spark, sf), doomed)
    # four one-row totals side by side (a union of tagged counts, pivoted by one global aggregate)
    tagged = (left["jobs"].select(F.lit("jobs_left").alias("k"))
              .unionByName(left["versions"].select(F.lit("versions_left").alias("k")))
              .unionByName(left["artifacts"].select(F.lit("artifacts_left").alias("k")))
              .unionByName(doomed.select(F.lit("jobs_deleted").alias("k"))))
    return tagged.agg(*[F.count_if(F.col("k") == n).alias(n)
                        for n in ("jobs_left", "versions_left", "artifacts_left", "jobs_deleted")])


@register("cascade_delete_pages", "R3", sql=with_views("d_job", "d_version") + """
, doomed AS (SELECT id FROM d_job WHERE status = 'failed' AND started_at < TIMESTAMP '1996-01-01 00:00:00')
, page AS (SELECT page_id, job_id FROM d_version
           QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY created_at DESC, id DESC) = 1)
SELECT v.id, v.page_id, v.job_id FROM d_version v JOIN page p ON p.page_id = v.page_id
WHERE v.job_id NOT IN (SELECT id FROM doomed) AND p.job_id NOT IN (SELECT id FROM doomed)""")
def q_cascade_pages(spark, sf):
    """Versions left after a deletion of jobs: those of other jobs go with the
    pages that a deleted job saw last."""
    jobs, versions = D.jobs(spark, sf), D.page_versions(spark, sf)
    doomed = jobs.filter((F.col("status") == "failed") &
                         (F.col("started_at") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))).select("id")
    pages = C.latest_version_per_page(versions, ["job_id"])
    left = C.cascade_delete_jobs(jobs, versions, D.artifacts(spark, sf), doomed, pages)
    return left["versions"].select("id", "page_id", "job_id")


@register("content_load", "A5", sql=with_views("d_version") + """
SELECT v.id, 'pages/' || v.page_id || '.md' AS path, length(coalesce(p.html, '')) AS content_chars,
       sha256(coalesce(p.html, '')) AS content_sha256
FROM d_version v LEFT JOIN pages p ON p.page_id = v.page_id""")
def q_content_load(spark, sf):
    """Versions with their stored text; a path that holds nothing reads as ''."""
    def path(c):
        return F.concat(F.lit("pages/"), F.col(c).cast("string"), F.lit(".md")).alias("path")
    stored = D.crawled_pages(spark, sf).select(path("page_id"), F.col("raw_md").alias("content"))
    v = store.load_content(D.page_versions(spark, sf).select("id", path("page_id")), stored, "path")
    return v.select("id", "path", F.length("content").cast("long").alias("content_chars"), F.sha2("content", 256).alias("content_sha256"))


@register("profile_delete_and_domain_restrict", "R3,C8", sql=with_views("d_domain", "d_job") + """
SELECT d.id, CASE WHEN d.profile_id % 5 = 0 THEN NULL ELSE d.profile_id END AS profile_id,
       NOT EXISTS (SELECT 1 FROM d_job j WHERE j.domain_id = d.id) AS deletable
FROM d_domain d""")
def q_profile_delete(spark, sf):
    doms = D.domains(spark, sf)
    gone = D.profiles(spark, sf).filter(F.col("id") % 5 == 0)
    after = C.delete_profiles(doms, gone).select("id", "profile_id")
    free = C.deletable_domains(doms, D.jobs(spark, sf)).select("id", F.lit(True).alias("deletable"))
    return after.join(free, "id", "left").select("id", "profile_id",
                                                 F.coalesce("deletable", F.lit(False)).alias("deletable"))


@register("current_artifacts_fallback", "E5", sql=_CUR_SQL.replace(
    "SELECT s.domain_id, s.kind, s.job_id, c.id, c.version, c.created_at\nFROM slots s LEFT JOIN cur c ON c.domain_id = s.domain_id AND c.kind = s.kind",
    """, anyf AS (SELECT a.domain_id, a.kind, a.id, a.job_id, a.version, a.created_at FROM d_artifact a
          WHERE a.job_id IN (SELECT id FROM d_job WHERE status = 'finished')
          QUALIFY row_number() OVER (PARTITION BY a.domain_id, a.kind ORDER BY a.created_at DESC, a.id DESC) = 1)
, cur2 AS (SELECT s.domain_id, s.kind, s.job_id, c.id, c.version, c.created_at
           FROM slots s LEFT JOIN cur c ON c.domain_id = s.domain_id AND c.kind = s.kind)
SELECT c.domain_id, c.kind,
       CASE WHEN c.id IS NULL THEN anyf.id ELSE c.id END AS id,
       CASE WHEN c.id IS NULL THEN anyf.job_id ELSE c.job_id END AS job_id,
       CASE WHEN c.id IS NULL THEN anyf.version ELSE c.version END AS version,
       CASE WHEN c.id IS NULL THEN anyf.created_at ELSE c.created_at END AS created_at
FROM cur2 c LEFT JOIN anyf ON c.domain_id = anyf.domain_id AND c.kind = anyf.kind"""))
def q_current_artifacts_fallback(spark, sf):
    """E5 with ``fallback=True``: when the latest finished job made no
    artifact of a kind, the newest one of any finished job is current."""
    return C.current_artifacts(D.artifacts(spark, sf), D.jobs(spark, sf), fallback=True)


@register("duplicate_domains", "R1", sql=with_views("d_domain") + """
SELECT domain, count(*) AS n FROM d_domain GROUP BY domain HAVING count(*) > 1""")
def q_duplicate_domains(spark, sf):
    return C.duplicate_keys(D.domains(spark, sf), ["domain"])


@register("orphan_report", "R2", sql=with_views("d_job", "d_domain", "d_version_page", "d_artifact", "d_profile") + """
SELECT 'job.domain_id' AS fk, count(*) AS orphans FROM d_job WHERE domain_id NOT IN (SELECT id FROM d_domain)
UNION ALL SELECT 'domain.profile_id', count(*) FROM d_domain
  WHERE profile_id IS NOT NULL AND profile_id NOT IN (SELECT id FROM d_profile)
UNION ALL SELECT 'version.job_id', count(*) FROM d_version_page WHERE job_id NOT IN (SELECT id FROM d_job)
UNION ALL SELECT 'version.page_domain', count(*) FROM d_version_page WHERE domain_id NOT IN (SELECT id FROM d_domain)
UNION ALL SELECT 'artifact.job_id', count(*) FROM d_artifact WHERE job_id NOT IN (SELECT id FROM d_job)
UNION ALL SELECT 'artifact.domain_id', count(*) FROM d_artifact WHERE domain_id NOT IN (SELECT id FROM d_domain)
UNION ALL SELECT 'page.job_id', count(*) FROM (SELECT DISTINCT domain_id, url, job_id FROM d_version_page)
  WHERE job_id NOT IN (SELECT id FROM d_job)""")
def q_orphan_report(spark, sf):
    """R2 over the seven references: orphan count per foreign key (left anti
    joins, counted by one aggregate over their tagged union)."""
    jobs, doms = D.jobs(spark, sf), D.domains(spark, sf)
    vp, arts, profs = D.job_page_versions(spark, sf), D.artifacts(spark, sf), D.profiles(spark, sf)
    checks = [("job.domain_id", C.orphans(jobs, "domain_id", doms)),
              ("domain.profile_id", C.orphans(doms, "profile_id", profs)),
              ("version.job_id", C.orphans(vp, "job_id", jobs)),
              ("version.page_domain", C.orphans(vp, "domain_id", doms)),
              ("artifact.job_id", C.orphans(arts, "job_id", jobs)),
              ("artifact.domain_id", C.orphans(arts, "domain_id", doms)),
              # a page's job is a column of it: pages are told apart among the orphans only
              ("page.job_id", C.orphans(vp.select("domain_id", "url", "job_id"), "job_id", jobs).distinct())]
    names = spark.createDataFrame([(n,) for n, _ in checks], "fk string")   # the seven key names
    tagged = None
    for n, df in checks:
        t = df.select(F.lit(n).alias("fk"))
        tagged = t if tagged is None else tagged.unionByName(t)
    counts = tagged.groupBy("fk").agg(F.count(F.lit(1)).alias("orphans"))
    return names.join(counts, "fk", "left").select("fk", F.coalesce("orphans", F.lit(0)).alias("orphans"))
