"""Scheduling queries (K1-K5) and crawl-request admission.

Every rule takes an explicit ``as_of`` timestamp instead of the wall clock, so
a run is reproducible and a backfill can ask "what was due at time t".
The per-domain inputs are top-1 aggregates (map-side combinable); the
exclusion of domains with a running job is a ``left_anti`` join on the domain
key. Admission numbers the waiting requests by a global sort and takes those
below the free slots, so any number of slots is dealt in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import crawl_domain_valid, normalize_domain
from .catalog import latest_finished_job_per_domain, latest_job_per_domain
from .changes import numbered


def _ms(ts) -> Column:
    return F.unix_millis(F.to_timestamp(ts))


def _as_of(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def due_before_ongoing(domains: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """K1 first half: active domains whose latest finished job finished at
    least ``check_interval_minutes`` whole minutes before ``as_of``."""
    last = latest_finished_job_per_domain(jobs).select(
        F.col("domain_id").alias("id"), F.col("finished_at").alias("last_crawled_at"))
    mins = F.floor((_ms(_as_of(as_of)) - _ms(F.col("last_crawled_at"))) / 60000).cast("long")
    return (domains.filter("is_active").join(last, "id")
                   .filter(F.col("last_crawled_at").isNotNull())
                   .withColumn("minutes_since_last_crawl", mins)
                   .filter(F.col("minutes_since_last_crawl") >= F.col("check_interval_minutes"))
                   .select("id", "domain", "check_interval_minutes", "last_crawled_at",
                           "minutes_since_last_crawl"))


def ongoing_domains(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status") == "processing").select(F.col("domain_id").alias("id"))


def due_domains_scheduled(domains: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:   # K1 + C5
    return due_before_ongoing(domains, jobs, as_of).join(ongoing_domains(jobs), "id", "left_anti")


def due_domains_service(domains: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:     # K2
    """Service form: never-crawled domains are due; the latest job of any
    status decides; an unfinished latest job is not due; millisecond compare."""
    last = latest_job_per_domain(jobs).select(
        F.col("domain_id").alias("id"), F.col("id").alias("last_job_id"),
        F.col("finished_at").alias("last_finished_at"))
    d = domains.filter("is_active").join(last, "id", "left")
    due = (F.col("last_job_id").isNull() |
           (F.col("last_finished_at").isNotNull() &
            ((_ms(_as_of(as_of)) - _ms(F.col("last_finished_at"))) >=
             F.col("check_interval_minutes").cast("long") * 60000)))
    return d.filter(due).select("id", "domain", "check_interval_minutes", "last_job_id", "last_finished_at")


def recrawl_summary(domains: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:          # K3
    """One row: domains to recrawl and how many due ones were skipped because
    a job is running (semi join for the flag, one global aggregate)."""
    due = due_before_ongoing(domains, jobs, as_of)
    busy = ongoing_domains(jobs).distinct().withColumn("_busy", F.lit(True))
    flagged = due.join(busy, "id", "left")
    return flagged.agg(F.count_if(F.col("_busy").isNull()).alias("total"),
                       F.count_if(F.col("_busy").isNotNull()).alias("skipped_due_to_ongoing_jobs"))


def ingest_requests(due: DataFrame, as_of: str) -> DataFrame:                              # K4
    return due.select(F.col("id").alias("domain_id"), F.lit("update").alias("type"),
                      F.lit("scheduler").alias("requested_by"), _as_of(as_of).alias("scheduled_at"))


def waiting_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """The oldest request of each domain that has no running job. ``requests``:
    domain_id, requested_at, request_id."""
    waiting = requests.join(ongoing_domains(jobs).withColumnRenamed("id", "domain_id"), "domain_id", "left_anti")
    first = waiting.groupBy("domain_id").agg(F.min(F.struct("requested_at", "request_id")).alias("_f"))
    return first.select("domain_id", F.col("_f.requested_at").alias("requested_at"), F.col("_f.request_id").alias("request_id"))


def admit_oldest(waiting: DataFrame, free: int) -> DataFrame:
    """The ``free`` oldest of the waiting requests, by their number in a global
    sort: any number of slots is dealt without a merge in one task."""
    if free <= 0:
        return waiting.limit(0)
    return numbered(waiting, ["requested_at", "request_id"], "_n").where(F.col("_n") < free).drop("_n")


def admit_crawls(requests: DataFrame, jobs: DataFrame, slots: int = 5) -> DataFrame:       # K5
    """At most one active crawl per domain (domains with a running job wait,
    and only their oldest request counts), oldest first, into the slots that
    running jobs leave free of ``slots``."""
    running = jobs.filter(F.col("status") == "processing").count()
    return admit_oldest(waiting_requests(requests, jobs), slots - running)


def validate_crawl_requests(requests: DataFrame, domains: DataFrame, jobs: DataFrame) -> DataFrame:  # B7 + J1
    """Verdict per request: invalid / rejected_inactive / conflict / accepted,
    with whether the domain is new (it would be created)."""
    r = requests.withColumn("normalized_domain", normalize_domain(F.col("url")))
    d = domains.select(F.col("domain").alias("normalized_domain"), F.col("id").alias("domain_id"), "is_active")
    busy = ongoing_domains(jobs).distinct().select(F.col("id").alias("domain_id"), F.lit(True).alias("_busy"))
    j = r.join(d, "normalized_domain", "left").join(busy, "domain_id", "left")
    verdict = (F.when(~crawl_domain_valid(F.col("normalized_domain")), "invalid")
               .when(F.col("domain_id").isNotNull() & ~F.col("is_active"), "rejected_inactive")
               .when(F.col("_busy").isNotNull(), "conflict")
               .otherwise("accepted"))
    return j.select("request_id", "url", "normalized_domain", "domain_id",
                    F.col("domain_id").isNull().alias("is_new_domain"), verdict.alias("verdict"))
