"""Job state from crawl events, batch form.

The reference keeps counters that every handler increments; here every
counter is *derived* by aggregation over the event log, so a replayed or
reordered log gives the same answer. The streaming jobs in
``sitegrove.streaming`` compute the same things incrementally.

Scale notes: every per-job quantity is a grouped aggregate on the job key
(map-side partial aggregation); the ready trigger needs the event order
inside a job, which is one window over (job ordered by time) after the
events were reduced to (job, ts, +received, +processed, close) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import json_merge, normalize_domain
from .changes import numbered

DEFAULT_INTERVAL = 1440
DEFAULT_MODEL = "openai/gpt-5"  # fixed value: the reference's default model name


# ----------------------------------------------------------------------------- A3 / B8 / S5

def lookup_jobs(events: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A3: resolve the external crawl id to a job. Returns (matched, unmatched);
    unmatched events are the reference's 404s."""
    j = jobs.select(F.col("external_id"), F.col("id").alias("job_id"), "domain_id",
                    F.col("status").alias("job_status"))
    ev = events.drop("job_id") if "job_id" in events.columns else events
    return ev.join(j, "external_id", "inner"), ev.join(j, "external_id", "left_anti")


def accept_for_job(matched: DataFrame) -> DataFrame:
    """B8 + S5: page events count only for a job in 'processing' (pages of
    canceled, failed or finished jobs are dropped, the stated intent)."""
    return matched.filter(F.col("job_status") == "processing")


# ----------------------------------------------------------------------------- S1

def dedupe_page_events(pages: DataFrame, keys=("job_id", "url", "scrape_id")) -> DataFrame:
    """S1 batch form: one delivery per (job, url, scrapeId), the earliest
    (ts, event_id, doc_pos) wins; map-side combinable."""
    keys = list(keys)
    rest = [c for c in pages.columns if c not in keys]
    first = pages.groupBy(*keys).agg(F.min(F.struct("ts", "event_id", "doc_pos", *[c for c in rest if c not in
                                                                                      ("ts", "event_id", "doc_pos")]))
                                     .alias("_f"))
    return first.select(*keys, "_f.*")


# ----------------------------------------------------------------------------- processing

def processed_events(pages: DataFrame) -> DataFrame:
    """Page processing completions derived from received pages (fixed rule):
    done (ts + event_id % 7 seconds) unless event_id % 10 = 9 (never finishes)."""
    return (pages.filter(F.col("event_id") % 10 != 9)
                 .select("job_id", "url", "scrape_id",
                         F.expr("timestampadd(SECOND, CAST(event_id % 7 AS INT), ts)").alias("ts")))


def job_events(matched: DataFrame) -> DataFrame:
    """One (job_id, ts, kind) row per step: 1 = page received, 2 = page
    processed, 3 = stream closed. ``matched``: the log's page documents and
    closes with their job. One aggregate dedupes the pages (S1) and carries the
    closes, whose event id is their key, and one generator makes the steps: the
    log is read once whatever reads the steps."""
    page = F.col("type") == "crawl.page"
    rows = matched.filter((page & (F.col("job_status") == "processing")) | (F.col("type") == "crawl.completed"))
    rows = rows.select("job_id", page.alias("page"), F.when(page, F.col("url")).alias("url"),
                       F.when(page, F.col("scrape_id")).alias("scrape_id"), F.when(~page, F.col("event_id")).alias("close_id"),
                       F.struct("ts", "event_id", "doc_pos").alias("first"))
    once = rows.groupBy("job_id", "page", "url", "scrape_id", "close_id").agg(F.min("first").alias("first"))
    ts, event = F.col("first.ts"), F.col("first.event_id")
    recv = F.struct(ts.alias("ts"), F.lit(1).alias("kind"))
    proc = F.struct((ts + F.make_dt_interval(secs=(event % 7).cast("decimal(18,6)"))).alias("ts"), F.lit(2).alias("kind"))
    close = F.struct(ts.alias("ts"), F.lit(3).alias("kind"))
    steps = F.when(~F.col("page"), F.array(close)).when(event % 10 != 9, F.array(recv, proc)).otherwise(F.array(recv))
    return once.select("job_id", F.explode(steps).alias("e")).select("job_id", "e.ts", "e.kind")


# ----------------------------------------------------------------------------- S2 / D6

def job_progress(events: DataFrame) -> DataFrame:
    """Pages received and processed per job, stream closed flag; one
    aggregate over the job events."""
    k = F.col("kind")
    return events.groupBy("job_id").agg(
        F.count_if(k == 1).alias("pages_received"),
        F.count_if(k == 2).alias("pages_processed"),
        (F.count_if(k == 3) > 0).alias("stream_closed"),
        F.min(F.when(k == 3, F.col("ts"))).alias("closed_at"),
        F.max("ts").alias("last_event_at"))


# ----------------------------------------------------------------------------- S3

def ready_triggers(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """S3 batch form: exactly one trigger per job, at the first processed-page
    or close event after which the stream is closed, every received page is
    processed and at least one page was processed.

    The running counts are split so no job lands whole in one task: events
    are summed per (job, time bucket) -- a map-side aggregate -- the bucket
    totals get a running sum per job (one row per bucket, small), and the
    running count inside a bucket is a window over (job, bucket) only. A job
    with a third of all events is spread over its buckets.
    """
    k = F.col("kind")
    ev = events.select("job_id", "ts", "kind", F.date_trunc(bucket, "ts").alias("bucket"),
                       (k == 1).cast("long").alias("d_rec"), (k == 2).cast("long").alias("d_proc"),
                       (k == 3).cast("long").alias("d_close"))
    per_bucket = ev.groupBy("job_id", "bucket").agg(F.sum("d_rec").alias("b_rec"), F.sum("d_proc").alias("b_proc"),
                                                    F.sum("d_close").alias("b_close"))
    before = Window.partitionBy("job_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("job_id", "bucket",
                                *[F.coalesce(F.sum(f"b_{n}").over(before), F.lit(0)).alias(f"o_{n}")
                                  for n in ("rec", "proc", "close")])
    inside = Window.partitionBy("job_id", "bucket").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    run = (ev.select("job_id", "bucket", "ts", "kind",
                     *[F.sum(f"d_{n}").over(inside).alias(f"c_{n}") for n in ("rec", "proc", "close")])
             .join(offsets, ["job_id", "bucket"])
             .select("job_id", "ts", "kind", (F.col("o_rec") + F.col("c_rec")).alias("rec"),
                     (F.col("o_proc") + F.col("c_proc")).alias("proc"),
                     (F.col("o_close") + F.col("c_close")).alias("closed")))
    hit = run.filter((F.col("kind") >= 2) & (F.col("closed") > 0) & (F.col("rec") == F.col("proc")) &
                     (F.col("proc") > 0))
    first = hit.groupBy("job_id").agg(F.min(F.struct("ts", "kind", "proc")).alias("_f"))
    return first.select("job_id", F.col("_f.ts").alias("ready_at"),
                        F.when(F.col("_f.kind") == 3, "close").otherwise("last_page").alias("fired_by"),
                        F.col("_f.proc").alias("completed_pages"))


# ----------------------------------------------------------------------------- S4

def rate_windows(pages: DataFrame, seconds: int = 10, limit: int = 100) -> DataFrame:
    """Page events per tumbling window, and whether the intake limit
    (100 per 10 s) was exceeded."""
    w = F.window("ts", f"{seconds} seconds")
    return (pages.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("events"))
                 .select(F.col("w.start").alias("window_start"), "events",
                         (F.col("events") > limit).alias("over_limit"),
                         F.greatest(F.col("events") - limit, F.lit(0)).alias("deferred")))


def throttle_backlog(pages: DataFrame, seconds: int = 10, limit: int = 100) -> DataFrame:
    """S4 with carry-over: what a window defers waits for the next ones, ``limit``
    a window. (window, window_start, events, earlier, backlog_before,
    backlog_after); ``window`` counts windows from the epoch, ``earlier`` the
    events of all earlier windows.

    The backlog before a window is p - min(p so far), where p is what came before
    less what all earlier windows can take (empty ones too), so it is prefix sums
    and prefix minima: inside buckets of 360 windows, and over one row a bucket."""
    w = pages.groupBy(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds).cast("long").alias("window")).agg(F.count(F.lit(1)).alias("events"))
    w = w.withColumn("_b", F.expr("window div 360"))
    inside = Window.partitionBy("_b").orderBy("window")
    w = w.withColumn("_in", F.sum("events").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("events"))
    w = w.withColumn("_p", F.col("_in") - limit * F.col("window"))
    per = w.groupBy("_b").agg(F.sum("events").alias("_n"), F.min("_p").alias("_m"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    per = per.withColumn("_low", F.min(F.col("_m") + F.col("_off")).over(before)).select("_b", "_off", "_low")
    x = w.join(per, "_b").withColumn("_p", F.col("_p") + F.col("_off"))
    low = F.min("_p").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("backlog_before", F.col("_p") - F.least(low, F.col("_low")))
    return x.select("window", F.timestamp_seconds(F.col("window") * seconds).cast("timestamp_ntz").alias("window_start"), "events",
                    (F.col("_off") + F.col("_in")).alias("earlier"), "backlog_before",
                    F.greatest(F.col("backlog_before") + F.col("events") - limit, F.lit(0)).alias("backlog_after"))


def start_delays(pages: DataFrame, seconds: int = 10, limit: int = 100) -> DataFrame:
    """Each page event with the seconds it waits for its turn, first come first
    served: its number in the global order gives its place in its window's queue."""
    order = ["ts", "event_id", "doc_pos", "job_id", "url"]
    q = throttle_backlog(pages, seconds, limit).select("window", "earlier", "backlog_before")
    n = numbered(pages.select(*order), order, "_n").withColumn("window", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds).cast("long"))
    ahead = F.col("backlog_before") + F.col("_n") - F.col("earlier")
    return n.join(q, "window").select(*order, (F.floor(ahead / limit) * seconds).cast("long").alias("delay_seconds"))


# ----------------------------------------------------------------------------- S6 / J9

def close_bookkeeping(events: DataFrame, existing_stats: DataFrame | None = None) -> DataFrame:
    """At close, record how many pages were received and processed by then
    and a note, merged (J9, right side wins) into the job's stats JSON. A row of
    ``events`` counts ``n`` times where there is such a column."""
    n = F.col("n") if "n" in events.columns else F.lit(1).cast("long")
    closes = events.filter(F.col("kind") == 3).groupBy("job_id").agg(F.min("ts").alias("closed_at"))
    e = events.join(closes, "job_id")
    before = F.col("ts") <= F.col("closed_at")
    x = e.groupBy("job_id").agg(F.first("closed_at").alias("closed_at"),
                                F.coalesce(F.sum(F.when((F.col("kind") == 1) & before, n)), F.lit(0)).alias("rec"),
                                F.coalesce(F.sum(F.when((F.col("kind") == 2) & before, n)), F.lit(0)).alias("proc"))
    note = F.to_json(F.struct(F.lit(True).alias("streamClosed"), F.col("proc").alias("pagesProcessedAtClose"),
                              F.col("rec").alias("pagesReceivedAtClose"),
                              F.format_string("Stream closed. Received: %d, Processed: %d", "rec", "proc").alias("note")))
    x = x.withColumn("close_stats", note)
    if existing_stats is not None:
        x = x.join(existing_stats.select("job_id", "stats"), "job_id", "left")
        x = x.withColumn("stats", json_merge(F.col("stats"), F.col("close_stats")))
    else:
        x = x.withColumn("stats", json_merge(F.lit(None).cast("string"), F.col("close_stats")))
    return x.select("job_id", "closed_at", F.col("rec").alias("pages_received_at_close"),
                    F.col("proc").alias("pages_processed_at_close"), "stats")


# ----------------------------------------------------------------------------- S7

def stalled_jobs(progress: DataFrame, as_of: str, timeout_minutes: int = 60) -> DataFrame:
    """Jobs not ready whose last event is older than the timeout:
    never closed, or received more pages than processed."""
    cut = F.expr(f"timestampadd(MINUTE, -{int(timeout_minutes)}, TIMESTAMP_NTZ '{as_of}')")
    reason = (F.when(~F.col("stream_closed"), F.lit("stream not closed"))
              .when(F.col("pages_received") > F.col("pages_processed"), F.lit("pages not processed"))
              .when(F.col("pages_processed") == 0, F.lit("no pages")))
    return (progress.withColumn("stall_reason", reason)
                    .filter(F.col("stall_reason").isNotNull() & (F.col("last_event_at") < cut))
                    .select("job_id", "pages_received", "pages_processed", "stream_closed", "last_event_at",
                            "stall_reason"))


# ----------------------------------------------------------------------------- M4 / B9

def cancel_verdicts(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Only a 'processing' job can be canceled; unknown jobs are 404s."""
    j = jobs.select(F.col("id").alias("job_id"), F.col("status").alias("job_status"))
    x = requests.join(j, "job_id", "left")
    verdict = (F.when(F.col("job_status").isNull(), "not_found")
               .when(F.col("job_status") == "processing", "canceled").otherwise("not_cancelable"))
    return x.select("request_id", "job_id", "requested_at", "job_status", verdict.alias("verdict"))


def fold_job_state(jobs: DataFrame, terminal: DataFrame) -> DataFrame:
    """M4: status, finished_at and stats from the stored job and the event log.
    ``terminal``: (job_id, ts, status, stats, merge) for completion -> finished,
    failure -> failed, cancel -> canceled. The first terminal state wins and
    absorbs what comes later; a stored one is the first. The event's stats
    replace the job's, or are merged into them (J9) where ``merge`` holds. A job
    without any keeps its stored row."""
    first = terminal.groupBy("job_id").agg(F.min(F.struct("ts", "status", "stats", "merge")).alias("_t"))
    stats = F.col("stats") if "stats" in jobs.columns else F.lit(None).cast("string")
    j = jobs.select(F.col("id").alias("job_id"), F.col("status").alias("prior_status"),
                    F.col("finished_at").alias("_f"), stats.alias("_s"))
    x = j.join(first, "job_id", "left")
    folds = (F.col("prior_status") == "processing") & F.col("_t").isNotNull()
    return x.select("job_id", "prior_status",
                    F.when(folds, F.col("_t.status")).otherwise(F.col("prior_status")).alias("status"),
                    F.when(folds, F.col("_t.ts")).otherwise(F.col("_f")).alias("finished_at"),
                    F.when(folds & F.col("_t.merge"), json_merge(F.col("_s"), F.col("_t.stats")))
                     .when(folds, F.col("_t.stats")).otherwise(F.col("_s")).alias("stats"))


# ----------------------------------------------------------------------------- M1 / M2

def upsert_pages(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """M1: page table keyed by (domain_id, url): a new key is inserted, an
    existing key gets the job id of its latest arrival (last write wins).
    ``existing``: domain_id, url, page_id, job_id; ``incoming``: domain_id,
    url, job_id, ts."""
    old = existing.select("domain_id", "url", "page_id", "job_id",
                          F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(0).alias("_src"))
    new = incoming.select("domain_id", "url", F.lit(None).cast("long").alias("page_id"), "job_id", "ts",
                          F.lit(1).alias("_src"))
    u = old.unionByName(new)
    last = u.groupBy("domain_id", "url").agg(
        F.max(F.struct("_src", "ts", "job_id")).alias("_l"),
        F.max("page_id").alias("page_id"))
    pid = F.coalesce(F.col("page_id"), F.xxhash64("domain_id", "url"))
    return last.select("domain_id", "url", pid.alias("page_id"), F.col("_l.job_id").alias("job_id"),
                       F.col("page_id").isNull().alias("inserted"))


def get_or_create_domains(requests: DataFrame, domains: DataFrame) -> DataFrame:
    """M2: domains named by requests that do not exist yet, created once (the
    first request wins) with the defaults: 1440 minutes, default model, active."""
    r = requests.withColumn("domain", normalize_domain(F.col("url")))
    r = r.filter((F.col("domain") != "") & F.col("domain").contains("."))
    new = r.join(domains.select("domain"), "domain", "left_anti")
    first = new.groupBy("domain").agg(F.min(F.struct("requested_at", "request_id")).alias("_f"))
    return first.select("domain", F.col("_f.request_id").alias("created_by_request"),
                        F.col("_f.requested_at").alias("created_at"),
                        F.lit(DEFAULT_INTERVAL).alias("check_interval_minutes"),
                        F.lit(DEFAULT_MODEL).alias("model"), F.lit(True).alias("is_active"))
