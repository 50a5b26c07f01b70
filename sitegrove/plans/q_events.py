"""Registered crawl-event queries.

Batch forms over the webhook log derived from ``events``; the streaming jobs
in ``sitegrove.streaming`` are checked against these in tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import AS_OF
from ..operators import jobstate as J
from ..sources import derived as D
from ..sources.tables import read_table
from ..sources import events as E
from .registry import register
from .sqlviews import with_views


def event_pipeline(spark, sf):
    """Shared lineage, parsed once and shuffled once: webhook log -> parse ->
    page documents and closes in one generator -> job lookup (broadcast-size
    dimension join) -> one hash repartition on (job_id, url). Every per-job
    aggregate below reads that exchange (Spark reuses it across branches) and
    needs no further shuffle for the dedupe on (job, url, scrapeId); per-job
    totals pre-aggregate within each partition before their own small shuffle."""
    jobs = D.jobs(spark, sf)
    parsed = E.parse_webhooks(E.webhook_payloads(D.crawl_events(spark, sf)))
    steps = E.explode_steps(parsed)
    matched, unmatched = J.lookup_jobs(steps, jobs)
    keyed = matched.repartition("job_id", "url")
    docs_matched = keyed.filter(F.col("type") == "crawl.page")
    pages = J.dedupe_page_events(J.accept_for_job(docs_matched).select(
        "job_id", "url", "scrape_id", "ts", "event_id", "doc_pos", "domain_id"))
    closes = keyed.filter(F.col("type") == "crawl.completed").select("job_id", "ts")
    return {"jobs": jobs, "parsed": parsed, "docs": E.explode_pages(parsed), "matched": docs_matched,
            "unmatched": unmatched, "pages": pages, "closes": closes, "processed": J.processed_events(pages),
            "events": J.job_events(matched)}


# SQL form of the same lineage (spelling rules of sources.events.webhook_payloads)
_EV_BODY = """
, st AS (SELECT *, CASE WHEN event_id % 89 = 0 THEN 'corrupt' WHEN event_id % 97 = 0 THEN 'unknown_type'
                        ELSE 'accepted' END AS status FROM d_event)
, docs AS (SELECT event_id, ts, external_id, 0 AS doc_pos,
                  CASE WHEN event_id % 3 = 0 THEN url WHEN event_id % 5 = 0 THEN url || '?src' ELSE url END AS url,
                  '# Page ' || regexp_extract(url, '/docs/(.*)$', 1) || chr(10) || chr(10) || 'Body of page '
                    || regexp_extract(url, '/docs/(.*)$', 1) AS markdown,
                  'Page ' || regexp_extract(url, '/docs/(.*)$', 1) AS title, scrape_id
           FROM st WHERE status = 'accepted' AND type = 'crawl.page'
           UNION ALL
           SELECT event_id, ts, external_id, 1, url || '/more', '', NULL, NULL
           FROM st WHERE status = 'accepted' AND type = 'crawl.page' AND event_id % 11 = 0)
, m AS (SELECT d.*, j.id AS job_id, j.domain_id, j.status AS job_status FROM docs d JOIN d_job j ON j.external_id = d.external_id)
, pages AS (SELECT job_id, url, scrape_id, ts, event_id, doc_pos, domain_id FROM m WHERE job_status = 'processing'
            QUALIFY row_number() OVER (PARTITION BY job_id, url, scrape_id ORDER BY ts, event_id, doc_pos) = 1)
, closes AS (SELECT j.id AS job_id, s.ts FROM st s JOIN d_job j ON j.external_id = s.external_id
             WHERE s.status = 'accepted' AND s.type = 'crawl.completed')
, processed AS (SELECT job_id, url, scrape_id, ts + to_seconds(CAST(event_id % 7 AS INTEGER)) AS ts FROM pages
                WHERE event_id % 10 <> 9)"""


def _ev(*views: str) -> str:
    return with_views("d_event", "d_job", *views) + _EV_BODY


_EV = _ev()


@register("webhook_routing", "A1", sql=_EV + """
SELECT event_id, ts, CASE WHEN status = 'corrupt' THEN NULL WHEN status = 'unknown_type' THEN 'crawl.paused' ELSE type END AS type,
       CASE WHEN status = 'corrupt' THEN NULL ELSE external_id END AS external_id, status
FROM st""")
def q_routing(spark, sf):
    return event_pipeline(spark, sf)["parsed"].drop("data")


@register("webhook_quarantine", "A1,A3", sql=_EV + """
SELECT event_id, ts, status AS reason FROM st WHERE status <> 'accepted'
UNION ALL SELECT event_id, ts, 'no_job' FROM st
          WHERE status = 'accepted' AND NOT EXISTS (SELECT 1 FROM d_job j WHERE j.external_id = st.external_id)""")
def q_quarantine(spark, sf):
    """Deliveries that count for nothing, and why: unreadable payloads, unknown
    types, and crawl ids that no job has (the reference's 404s)."""
    e = event_pipeline(spark, sf)
    parsed = e["parsed"]
    unknown = J.lookup_jobs(parsed.filter(F.col("status") == "accepted"), e["jobs"])[1]
    return (parsed.filter(F.col("status") != "accepted").select("event_id", "ts", F.col("status").alias("reason"))
            .unionByName(unknown.select("event_id", "ts", F.lit("no_job").alias("reason"))))


@register("page_documents", "A2", sql=_EV + """
SELECT event_id, ts, 'crawl.page' AS type, external_id, doc_pos, url, markdown, title, scrape_id FROM docs""")
def q_page_documents(spark, sf):
    return event_pipeline(spark, sf)["docs"]


@register("event_tally", "D9", sql=_EV + """
SELECT event_id, ts, type, external_id,
       CASE WHEN type = 'crawl.page' THEN CASE WHEN event_id % 11 = 0 THEN 2 ELSE 1 END END AS document_count,
       CASE WHEN type = 'crawl.completed' THEN CAST(floor(value) AS INTEGER) END AS pages_scraped,
       CASE WHEN type = 'crawl.failed' THEN 'timeout' END AS error
FROM st WHERE status = 'accepted'""")
def q_event_tally(spark, sf):
    return E.event_tally(event_pipeline(spark, sf)["parsed"])


@register("event_job_lookup", "A3,B8,S5", sql=_EV + """
SELECT event_id, doc_pos, job_id, domain_id, job_status, job_status = 'processing' AS counted FROM m""")
def q_event_lookup(spark, sf):
    m = event_pipeline(spark, sf)["matched"]
    return m.select("event_id", "doc_pos", "job_id", "domain_id", "job_status",
                    (F.col("job_status") == "processing").alias("counted"))


@register("page_event_dedupe", "S1", sql=_EV + """
SELECT job_id, url, scrape_id, ts, event_id, doc_pos, domain_id FROM pages""")
def q_dedupe(spark, sf):
    return event_pipeline(spark, sf)["pages"]


@register("job_progress", "S2,D6", sql=_EV + """
, r AS (SELECT job_id, count(*) AS n, max(ts) AS last_ts FROM pages GROUP BY job_id)
, p AS (SELECT job_id, count(*) AS n, max(ts) AS last_ts FROM processed GROUP BY job_id)
, c AS (SELECT job_id, min(ts) AS closed_at, max(ts) AS last_close FROM closes GROUP BY job_id)
, ids AS (SELECT job_id FROM r UNION SELECT job_id FROM p UNION SELECT job_id FROM c)
SELECT ids.job_id, coalesce(r.n, 0) AS pages_received, coalesce(p.n, 0) AS pages_processed,
       c.closed_at IS NOT NULL AS stream_closed, c.closed_at,
       greatest(r.last_ts, p.last_ts, c.last_close) AS last_event_at
FROM ids LEFT JOIN r ON r.job_id = ids.job_id LEFT JOIN p ON p.job_id = ids.job_id LEFT JOIN c ON c.job_id = ids.job_id""")
def q_progress(spark, sf):
    return J.job_progress(event_pipeline(spark, sf)["events"])


@register("ready_triggers", "S3", sql=_EV + """
, ev AS (SELECT job_id, ts, 1 AS kind, 1 AS d_rec, 0 AS d_proc, 0 AS d_close FROM pages
         UNION ALL SELECT job_id, ts, 2, 0, 1, 0 FROM processed
         UNION ALL SELECT job_id, ts, 3, 0, 0, 1 FROM closes)
, run AS (SELECT job_id, ts, kind,
                 sum(d_rec) OVER w AS rec, sum(d_proc) OVER w AS proc, sum(d_close) OVER w AS closed
          FROM ev WINDOW w AS (PARTITION BY job_id ORDER BY ts, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT job_id, ts AS ready_at, CASE WHEN kind = 3 THEN 'close' ELSE 'last_page' END AS fired_by,
       CAST(proc AS BIGINT) AS completed_pages
FROM run WHERE kind >= 2 AND closed > 0 AND rec = proc AND proc > 0
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts, kind, proc) = 1""")
def q_ready(spark, sf):
    return J.ready_triggers(event_pipeline(spark, sf)["events"])


@register("rate_windows", "S4", sql=_EV + """
SELECT time_bucket(INTERVAL 10 SECOND, ts) AS window_start, count(*) AS events, count(*) > 100 AS over_limit,
       greatest(count(*) - 100, 0) AS deferred
FROM pages GROUP BY 1""")
def q_rate(spark, sf):
    return J.rate_windows(event_pipeline(spark, sf)["pages"])


_QUEUE_SQL = """
, w AS (SELECT CAST(floor(epoch(ts) / 10) AS BIGINT) AS win, count(*) AS events FROM pages GROUP BY 1)
, l AS (SELECT CAST(ceil(avg(events)) AS BIGINT) AS cap FROM w)
, o AS (SELECT *, row_number() OVER (ORDER BY win) AS rn FROM w)
, q AS (SELECT win, events, rn, 0::BIGINT AS before, greatest(events - cap, 0) AS after FROM o, l WHERE rn = 1
        UNION ALL
        SELECT win, events, rn, before, greatest(before + events - cap, 0)
        FROM (SELECT o.win, o.events, o.rn, greatest(q.after - cap * (o.win - q.win - 1), 0) AS before, cap
              FROM q JOIN o ON o.rn = q.rn + 1, l))"""


def _cap(pages):
    """Events a window may start: the mean of the windows that have any, so that
    the limit binds at any size."""
    per = pages.groupBy(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 10).cast("long")).agg(F.count(F.lit(1)).alias("n"))
    return int(per.agg(F.ceil(F.avg("n"))).first()[0] or 1)


@register("throttle_backlog", "S4", sql=_EV.replace("WITH", "WITH RECURSIVE", 1) + _QUEUE_SQL + """
SELECT TIMESTAMP '1970-01-01 00:00:00' + to_seconds(win * 10) AS window_start, events, before AS backlog_before, after AS backlog_after FROM q""")
def q_throttle(spark, sf):
    pages = event_pipeline(spark, sf)["pages"]
    return J.throttle_backlog(pages, 10, _cap(pages)).select("window_start", "events", "backlog_before", "backlog_after")


@register("page_start_delays", "S4", sql=_EV.replace("WITH", "WITH RECURSIVE", 1) + _QUEUE_SQL + """
, n AS (SELECT *, row_number() OVER (PARTITION BY floor(epoch(ts) / 10) ORDER BY ts, event_id, doc_pos, job_id, url) - 1 AS place FROM pages)
SELECT n.ts, n.event_id, n.doc_pos, n.job_id, n.url, CAST((q.before + n.place) // cap * 10 AS BIGINT) AS delay_seconds
FROM n JOIN q ON q.win = CAST(floor(epoch(n.ts) / 10) AS BIGINT), l""")
def q_start_delays(spark, sf):
    pages = event_pipeline(spark, sf)["pages"]
    return J.start_delays(pages, 10, _cap(pages))


@register("close_bookkeeping", "S6,J9", sql=_EV + """
, c AS (SELECT job_id, min(ts) AS closed_at FROM closes GROUP BY job_id)
, r AS (SELECT c.job_id, count(p.job_id) AS rec FROM c LEFT JOIN pages p ON p.job_id = c.job_id AND p.ts <= c.closed_at
        GROUP BY c.job_id)
, q AS (SELECT c.job_id, count(p.job_id) AS proc FROM c LEFT JOIN processed p ON p.job_id = c.job_id AND p.ts <= c.closed_at
        GROUP BY c.job_id)
SELECT c.job_id, c.closed_at, r.rec AS pages_received_at_close, q.proc AS pages_processed_at_close,
       CAST(json_merge_patch(json_object('jobType', j.type, 'streamClosed', false),
                             json_object('streamClosed', true, 'pagesProcessedAtClose', q.proc,
                                         'pagesReceivedAtClose', r.rec,
                                         'note', 'Stream closed. Received: ' || r.rec || ', Processed: ' || q.proc))
            AS VARCHAR) AS stats
FROM c JOIN r ON r.job_id = c.job_id JOIN q ON q.job_id = c.job_id JOIN d_job j ON j.id = c.job_id""")
def q_close(spark, sf):
    """Stats JSON at close merged (J9, right side wins, key order and value
    types kept) into the job's stats."""
    e = event_pipeline(spark, sf)
    prior = e["jobs"].select(F.col("id").alias("job_id"),
                             F.to_json(F.struct(F.col("type").alias("jobType"),
                                                F.lit(False).alias("streamClosed"))).alias("stats"))
    return J.close_bookkeeping(e["events"], prior)


@register("stalled_jobs", "S7", sql=_EV + f"""
, r AS (SELECT job_id, count(*) AS n, max(ts) AS last_ts FROM pages GROUP BY job_id)
, p AS (SELECT job_id, count(*) AS n, max(ts) AS last_ts FROM processed GROUP BY job_id)
, c AS (SELECT job_id, min(ts) AS closed_at, max(ts) AS last_close FROM closes GROUP BY job_id)
, ids AS (SELECT job_id FROM r UNION SELECT job_id FROM p UNION SELECT job_id FROM c)
, g AS (SELECT ids.job_id, coalesce(r.n, 0) AS pages_received, coalesce(p.n, 0) AS pages_processed,
               c.closed_at IS NOT NULL AS stream_closed, greatest(r.last_ts, p.last_ts, c.last_close) AS last_event_at
        FROM ids LEFT JOIN r ON r.job_id = ids.job_id LEFT JOIN p ON p.job_id = ids.job_id
        LEFT JOIN c ON c.job_id = ids.job_id)
, s AS (SELECT *, CASE WHEN NOT stream_closed THEN 'stream not closed'
                       WHEN pages_received > pages_processed THEN 'pages not processed'
                       WHEN pages_processed = 0 THEN 'no pages' END AS stall_reason FROM g)
SELECT job_id, pages_received, pages_processed, stream_closed, last_event_at, stall_reason FROM s
WHERE stall_reason IS NOT NULL AND last_event_at < TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTE""")
def q_stalled(spark, sf):
    e = event_pipeline(spark, sf)
    return J.stalled_jobs(J.job_progress(e["events"]), AS_OF, 60)


def _cancel_requests(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("job_id"),
                    F.expr("timestampadd(DAY, 1, o_orderdate)").alias("requested_at"))


_CANCEL_SQL = """
, cr AS (SELECT o_orderkey AS request_id, o_orderkey AS job_id, o_orderdate + INTERVAL 1 DAY AS requested_at
         FROM orders)"""


@register("cancel_verdicts", "B9", sql=with_views("d_job") + _CANCEL_SQL + """
SELECT cr.request_id, cr.job_id, cr.requested_at, j.status AS job_status,
       CASE WHEN j.status IS NULL THEN 'not_found' WHEN j.status = 'processing' THEN 'canceled'
            ELSE 'not_cancelable' END AS verdict
FROM cr LEFT JOIN d_job j ON j.id = cr.job_id""")
def q_cancel(spark, sf):
    return J.cancel_verdicts(_cancel_requests(spark, sf), D.jobs(spark, sf))


@register("job_state_fold", "M4,B9,S5", sql=_ev("d_domain") + _CANCEL_SQL + """
, fails AS (SELECT j.id AS job_id, s.ts FROM st s JOIN d_job j ON j.external_id = s.external_id
            WHERE s.status = 'accepted' AND s.type = 'crawl.failed')
, t AS (SELECT c.job_id, c.ts, CASE WHEN d.is_active THEN 'finished' ELSE 'failed' END AS status,
               CASE WHEN d.is_active THEN '{"streamClosed":true}' ELSE '{"error":"domain inactive"}' END AS stats,
               d.is_active AS merge
        FROM closes c JOIN d_job j ON j.id = c.job_id JOIN d_domain d ON d.id = j.domain_id
        UNION ALL SELECT job_id, ts, 'failed', '{"error":"timeout"}', false FROM fails
        UNION ALL SELECT cr.job_id, cr.requested_at, 'canceled',
                         '{"canceledAt":"' || strftime(cr.requested_at, '%Y-%m-%dT%H:%M:%S.000Z') || '","reason":"Manually canceled"}',
                         false
                  FROM cr JOIN d_job j ON j.id = cr.job_id WHERE j.status = 'processing')
, f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts, status, stats) = 1)
, s AS (SELECT id, status, finished_at, json_object('jobType', type, 'streamClosed', false) AS stats FROM d_job)
SELECT s.id AS job_id, s.status AS prior_status,
       CASE WHEN s.status = 'processing' AND f.job_id IS NOT NULL THEN f.status ELSE s.status END AS status,
       CASE WHEN s.status = 'processing' AND f.job_id IS NOT NULL THEN f.ts ELSE s.finished_at END AS finished_at,
       CASE WHEN s.status = 'processing' AND f.merge THEN CAST(json_merge_patch(s.stats, f.stats) AS VARCHAR)
            WHEN s.status = 'processing' AND f.job_id IS NOT NULL THEN f.stats ELSE CAST(s.stats AS VARCHAR) END AS stats
FROM s LEFT JOIN f ON f.job_id = s.id""")
def q_fold(spark, sf):
    e = event_pipeline(spark, sf)
    fails = e["parsed"].filter((F.col("status") == "accepted") & (F.col("type") == "crawl.failed"))
    fails, _ = J.lookup_jobs(fails, e["jobs"])
    cancels = J.cancel_verdicts(_cancel_requests(spark, sf), e["jobs"]).filter(F.col("verdict") == "canceled")
    # a close for a job whose domain is no longer active fails the job
    active = (e["jobs"].select(F.col("id").alias("job_id"), "domain_id")
              .join(D.domains(spark, sf).select(F.col("id").alias("domain_id"), "is_active"), "domain_id"))
    on = F.col("is_active")
    closed = e["closes"].join(active, "job_id").select(
        "job_id", "ts", F.when(on, "finished").otherwise("failed").alias("status"),
        F.when(on, F.lit('{"streamClosed":true}')).otherwise(F.lit('{"error":"domain inactive"}')).alias("stats"), on.alias("merge"))
    canceled = F.to_json(F.struct(F.date_format("requested_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("canceledAt"),
                                  F.lit("Manually canceled").alias("reason")))
    terminal = (closed
                .unionByName(fails.select("job_id", "ts", F.lit("failed").alias("status"),
                                          F.lit('{"error":"timeout"}').alias("stats"), F.lit(False).alias("merge")))
                .unionByName(cancels.select("job_id", F.col("requested_at").alias("ts"), F.lit("canceled").alias("status"),
                                            canceled.alias("stats"), F.lit(False).alias("merge"))))
    stats = F.to_json(F.struct(F.col("type").alias("jobType"), F.lit(False).alias("streamClosed")))
    return J.fold_job_state(e["jobs"].withColumn("stats", stats), terminal)


@register("page_upsert", "M1", sql=_ev("d_version_page") + """
, vp AS (SELECT * FROM d_version_page)
, ex AS (SELECT domain_id, url, page_id, job_id FROM vp
         QUALIFY row_number() OVER (PARTITION BY domain_id, url ORDER BY created_at DESC, id DESC) = 1)
, u AS (SELECT domain_id, url, page_id, job_id, NULL::TIMESTAMP AS ts, 0 AS src FROM ex
        UNION ALL SELECT domain_id, url, NULL, job_id, ts, 1 FROM pages)
SELECT domain_id, url, arg_max(job_id, (src, ts, job_id)) AS job_id, max(page_id) IS NULL AS inserted
FROM u GROUP BY domain_id, url""")
def q_upsert(spark, sf):
    from ..operators.catalog import top1
    v = D.page_versions(spark, sf, with_page=True)
    existing = top1(v, ["domain_id", "url"], [F.col("created_at"), F.col("id")], ["page_id", "job_id"])
    incoming = event_pipeline(spark, sf)["pages"].select("domain_id", "url", "job_id", "ts")
    return J.upsert_pages(existing, incoming).drop("page_id")


@register("domain_get_or_create", "M2,J1", sql=with_views("d_request", "d_domain") + """
, r AS (SELECT request_id, requested_at,
               string_split(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', ''), '/$', ''), '/')[1] AS domain
        FROM d_request)
, n AS (SELECT * FROM r WHERE domain <> '' AND contains(domain, '.') AND domain NOT IN (SELECT domain FROM d_domain))
SELECT domain, arg_min(request_id, (requested_at, request_id)) AS created_by_request, min(requested_at) AS created_at,
       1440 AS check_interval_minutes, 'openai/gpt-5' AS model, true AS is_active
FROM n GROUP BY domain""")
def q_get_or_create(spark, sf):
    return J.get_or_create_domains(D.crawl_requests(spark, sf), D.domains(spark, sf))
