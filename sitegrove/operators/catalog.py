"""Catalog queries over domains, jobs, pages, versions, artifacts, profiles
(B, C, D, E, R).

Plan notes for scale:
* Top-1 per key (latest version, latest job, current artifact) is an
  aggregate ``max_by``-style ``max(struct(order keys..., payload))``: it is
  combined map-side, so a key holding a third of all rows is reduced before
  the shuffle instead of landing whole in one task as a window would.
* Top-k (k > 1) uses ``row_number() <= k``; Spark plans a partial
  ``WindowGroupLimit`` below the exchange, so at most k rows per key and map
  partition are shuffled.
* Counts per job are one pass of ``count``/``count_if`` pre-aggregated
  map-side, then joined to the (smaller) job table on the same key.
* Dimension joins (domain, profile) are left to AQE: it broadcasts a side
  only after measuring it below ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import js_round

def changed() -> Column:
    """B2 predicate: NULL importance counts as changed (kept for parity)."""
    return F.col("importance").isNull() | (F.col("importance") >= 2)


def skipped() -> Column:
    """B3 predicate."""
    return F.col("importance") < 2


def _ts(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def top1(df: DataFrame, keys: list[str], order: list[Column], cols: list[str]) -> DataFrame:
    """Row with the greatest ``order`` tuple per ``keys`` (ties broken by the
    order list itself, so include an id). Map-side combinable (skew safe)."""
    s = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in cols])
    return (df.groupBy(*keys).agg(F.max(s).alias("_top"))
              .select(*keys, *[F.col(f"_top.{c}").alias(c) for c in cols]))


# ---- B: filters -------------------------------------------------------------------------

def active_domains(domains: DataFrame, profiles: DataFrame) -> DataFrame:          # B1 + C1
    p = profiles.select(F.col("id").alias("profile_id"), F.col("name").alias("profile_name"),
                        F.col("summary_prompt"), F.col("version").alias("profile_version"))
    return domains.filter("is_active").join(p, "profile_id", "left")


def changed_versions(versions: DataFrame) -> DataFrame:                             # B2
    return versions.filter(changed())


def skipped_versions(versions: DataFrame) -> DataFrame:                             # B3
    return versions.filter(skipped())


def jobs_by_status(jobs: DataFrame, domains: DataFrame, status: str) -> DataFrame:  # B4
    d = domains.select(F.col("id").alias("domain_id"), "domain")
    return (jobs.filter(F.col("status") == status).join(d, "domain_id")
                .orderBy(F.col("started_at").desc(), F.col("id").desc()))


def job_search(jobs: DataFrame, versions: DataFrame, domains: DataFrame, status: str | None,
               domain: str | None, start: str, end: str, as_of: str, expected_pages: int = 100) -> DataFrame:   # B5
    """Jobs started in [start, end), with their pages so far, the share of the
    pages a crawl may fetch (in whole percent, 100 once finished) and duration."""
    j = jobs.filter((F.col("started_at") >= F.lit(start).cast("timestamp_ntz")) &
                    (F.col("started_at") < F.lit(end).cast("timestamp_ntz")))
    if status:
        j = j.filter(F.col("status") == status)
    d = domains.select(F.col("id").alias("domain_id"), "domain")
    if domain:
        d = d.filter(F.col("domain") == domain)
    counts = versions.groupBy("job_id").agg(F.count(F.lit(1)).alias("pages_processed"))
    end_ts = F.coalesce(F.col("finished_at"), _ts(as_of))
    dur = (F.unix_millis(F.to_timestamp(end_ts)) - F.unix_millis(F.to_timestamp("started_at"))) / 60000.0
    return (j.join(d, "domain_id")
             .join(counts.withColumnRenamed("job_id", "id"), "id", "left")
             .select("id", "domain", "status", "started_at", "finished_at",
                     F.coalesce("pages_processed", F.lit(0)).alias("pages_processed"),
                     F.when(F.col("status") == "finished", F.lit(100))
                      .otherwise(F.least(F.lit(100), F.floor(F.coalesce("pages_processed", F.lit(0)) * 100 / F.lit(expected_pages))))
                      .cast("long").alias("progress_percent"),
                     js_round(dur).cast("long").alias("duration_minutes")))


def domains_with_active_job(domains: DataFrame, jobs: DataFrame) -> DataFrame:     # B6
    busy = jobs.filter(F.col("status") == "processing").select(F.col("domain_id").alias("id"))
    return domains.join(busy, "id", "left_semi")


# ---- C: joins ---------------------------------------------------------------------------

def job_with_versions(jobs: DataFrame, domains: DataFrame, versions: DataFrame) -> DataFrame:  # C2
    d = domains.select(F.col("id").alias("domain_id"), "domain")
    nested = (versions.groupBy("job_id")
              .agg(F.array_sort(F.collect_list(F.struct("id", "page_id", "importance", "change_status")))
                   .alias("versions")))
    return (jobs.join(d, "domain_id")
                .join(nested.withColumnRenamed("job_id", "id"), "id", "left"))


def artifacts_with_job_domain(artifacts: DataFrame, jobs: DataFrame, domains: DataFrame) -> DataFrame:  # C4
    j = jobs.select(F.col("id").alias("job_id"), "started_at", "finished_at", "status")
    d = domains.select(F.col("id").alias("domain_id"), "domain")
    return artifacts.join(j, "job_id").join(d, "domain_id")


def profile_usage(profiles: DataFrame, domains: DataFrame) -> DataFrame:            # C8
    use = domains.filter(F.col("profile_id").isNotNull()).groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("domains_using"))
    p = profiles.select(F.col("id").alias("profile_id"), "name", "version")
    return (p.join(use, "profile_id", "left")
             .select("profile_id", "name", "version",
                     F.coalesce("domains_using", F.lit(0)).alias("domains_using"),
                     F.col("domains_using").isNull().alias("deletable")))


# ---- D: aggregates ----------------------------------------------------------------------

def version_counts(versions: DataFrame) -> DataFrame:                              # D1
    return versions.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(changed()).alias("changed"),
        F.count_if(skipped()).alias("skipped"))


def final_job_stats(jobs: DataFrame, versions: DataFrame, artifacts: DataFrame,
                    as_of: str, approx: bool = False) -> DataFrame:                 # D2 + D10
    """``approx``: unique pages by a sketch (2 % relative error) instead of exactly."""
    unique = F.approx_count_distinct("page_id", 0.02) if approx else F.count_distinct("page_id")
    v = versions.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_pages_processed"),
        unique.alias("unique_pages"),
        F.count_if(changed()).alias("changed_pages"),
        F.avg("importance").alias("_avg"))
    a = artifacts.groupBy("job_id").agg(F.count(F.lit(1)).alias("artifacts_generated"))
    end_ts = F.coalesce(F.col("finished_at"), _ts(as_of))
    dur_ms = F.unix_millis(F.to_timestamp(end_ts)) - F.unix_millis(F.to_timestamp("started_at"))
    avg2 = F.floor(F.col("_avg") * 100 + 0.5) / 100
    return (jobs.withColumnRenamed("id", "job_id")
                .join(v, "job_id", "left").join(a, "job_id", "left")
                .select("job_id", js_round(dur_ms / 60000.0).cast("long").alias("duration_minutes"),
                        F.coalesce("total_pages_processed", F.lit(0)).alias("total_pages_processed"),
                        F.coalesce("unique_pages", F.lit(0)).alias("unique_pages"),
                        F.coalesce("changed_pages", F.lit(0)).alias("changed_pages"),
                        F.when(F.col("_avg") != 0, avg2).alias("average_importance"),
                        F.coalesce("artifacts_generated", F.lit(0)).alias("artifacts_generated"),
                        F.lit(100).alias("completion_rate")))


def domain_dashboard(domains: DataFrame, jobs: DataFrame, versions_page: DataFrame,
                     versions: DataFrame | None = None) -> DataFrame:                  # D4
    """All domains: page count, last job, its version count (one aggregate
    join instead of the reference's per-domain loop). ``versions`` (without
    the page join) serves the per-job count when given."""
    pages = (versions_page.select("domain_id", "page_id").distinct()
             .groupBy("domain_id").agg(F.count(F.lit(1)).alias("page_count")))
    last = top1(jobs, ["domain_id"], [F.col("started_at"), F.col("id")], ["id", "status", "started_at"])
    last = last.select("domain_id", F.col("id").alias("last_job_id"), F.col("status").alias("last_job_status"),
                       F.col("started_at").alias("last_job_started_at"))
    vc = (versions if versions is not None else versions_page).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("last_job_versions"))
    d = domains.select(F.col("id").alias("domain_id"), "domain", "updated_at")
    return (d.join(pages, "domain_id", "left").join(last, "domain_id", "left")
             .join(vc.withColumnRenamed("job_id", "last_job_id"), "last_job_id", "left")
             .select("domain_id", "domain", "updated_at",
                     F.coalesce("page_count", F.lit(0)).alias("page_count"),
                     "last_job_id", "last_job_status", "last_job_started_at",
                     F.when(F.col("last_job_id").isNotNull(), F.coalesce("last_job_versions", F.lit(0)))
                      .alias("last_job_versions")))


def domain_detail(domains: DataFrame, jobs: DataFrame, versions_page: DataFrame) -> DataFrame:  # D5 + E1
    latest = top1(versions_page, ["domain_id", "url"], [F.col("created_at"), F.col("id")],
                  ["id", "page_id", "importance", "created_at"])
    pages = (latest.groupBy("domain_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.array_sort(F.collect_list(F.struct(F.col("url"), F.col("id").alias("latest_version_id"))))
         .alias("pages")))
    jc = jobs.groupBy("domain_id").agg(F.count(F.lit(1)).alias("job_count"))
    d = domains.select(F.col("id").alias("domain_id"), "domain")
    return (d.join(pages, "domain_id", "left").join(jc, "domain_id", "left")
             .select("domain_id", "domain", F.coalesce("page_count", F.lit(0)).alias("page_count"),
                     F.coalesce("job_count", F.lit(0)).alias("job_count"), "pages"))


# ---- E: top-1 / top-k --------------------------------------------------------------------

def latest_version_per_page(versions: DataFrame, cols: list[str]) -> DataFrame:    # E1
    return top1(versions, ["page_id"], [F.col("created_at"), F.col("id")], cols)


def latest_version_per_page_in_job(versions: DataFrame, cols: list[str]) -> DataFrame:  # E2
    return top1(versions, ["job_id", "page_id"], [F.col("created_at"), F.col("id")], cols)


def latest_job_per_domain(jobs: DataFrame) -> DataFrame:                            # E3
    return top1(jobs, ["domain_id"], [F.col("started_at"), F.col("id")],
                ["id", "status", "started_at", "finished_at"])


def latest_finished_job_per_domain(jobs: DataFrame) -> DataFrame:                   # E4
    # Postgres "finished_at desc" puts NULLs first: a NULL sorts above any time.
    f = jobs.filter(F.col("status") == "finished")
    return top1(f, ["domain_id"], [F.col("finished_at").isNull(), F.col("finished_at"), F.col("id")],
                ["id", "started_at", "finished_at"])


def current_artifacts(artifacts: DataFrame, jobs: DataFrame, fallback: bool = False) -> DataFrame:  # E5
    """Newest artifact of each kind in the domain's latest finished job; NULL
    for a kind that job did not make (or, with ``fallback``, the newest of
    that kind in any finished job)."""
    last = latest_finished_job_per_domain(jobs).select("domain_id", F.col("id").alias("job_id"))
    slots = last.select("domain_id", "job_id",
                        F.explode(F.array(F.lit("llms_txt"), F.lit("llms_full_txt"))).alias("kind"))
    a = artifacts.join(last, ["domain_id", "job_id"], "left_semi")
    newest = top1(a, ["domain_id", "kind"], [F.col("created_at"), F.col("id")],
                  ["id", "version", "created_at"])
    cur = slots.join(newest, ["domain_id", "kind"], "left")
    if fallback:
        fin = jobs.filter(F.col("status") == "finished").select(F.col("id").alias("job_id"))
        anyf = top1(artifacts.join(fin, "job_id", "left_semi"), ["domain_id", "kind"],
                    [F.col("created_at"), F.col("id")], ["id", "job_id", "version", "created_at"])
        cur = (cur.alias("c").join(anyf.alias("f"), ["domain_id", "kind"], "left")
               .select("domain_id", "kind",
                       *[F.when(F.col("c.id").isNull(), F.col(f"f.{c}")).otherwise(F.col(f"c.{c}")).alias(c)
                         for c in ["id", "job_id", "version", "created_at"]]))
    return cur


def artifact_history(artifacts: DataFrame, jobs: DataFrame, kind: str | None = None) -> DataFrame:  # E6
    fin = jobs.filter(F.col("status") == "finished").select(F.col("id").alias("job_id"), "finished_at")
    a = artifacts if kind is None else artifacts.filter(F.col("kind") == kind)
    return a.join(fin, "job_id").select("domain_id", "kind", "id", "job_id", "version", "created_at",
                                        "finished_at")


def retention_prune(artifacts: DataFrame, jobs: DataFrame, keep: int = 5) -> tuple[DataFrame, DataFrame]:  # E7
    """Per domain and kind keep the first ``keep`` of the history order
    (job finished_at desc, artifact created_at desc); returns (kept, dropped).
    The kept side is a top-k (``row_number() <= k`` runs as a partial group
    limit before the shuffle, so a domain with a huge history does not land
    whole in one task); the dropped side is the rest, by an anti join."""
    h = artifact_history(artifacts, jobs)
    w = Window.partitionBy("domain_id", "kind").orderBy(
        F.col("finished_at").desc_nulls_first(), F.col("created_at").desc(), F.col("id").desc())
    kept = h.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
    dropped = h.join(kept.select("id"), "id", "left_anti")
    return kept, dropped


def next_artifact_version(artifacts: DataFrame, domains: DataFrame) -> DataFrame:  # E8
    kinds = F.explode(F.array(F.lit("llms_txt"), F.lit("llms_full_txt"))).alias("kind")
    slots = domains.select(F.col("id").alias("domain_id"), kinds)
    mx = artifacts.groupBy("domain_id", "kind").agg(F.max("version").alias("_mx"))
    return (slots.join(mx, ["domain_id", "kind"], "left")
                 .select("domain_id", "kind", (F.coalesce("_mx", F.lit(0)) + 1).cast("int").alias("next_version")))


def first_pages(versions_page: DataFrame, n: int = 10) -> DataFrame:               # E11
    """First ``n`` urls (by url) and the page count per job."""
    urls = versions_page.select("job_id", "url").distinct()
    w = Window.partitionBy("job_id").orderBy("url")
    top = (urls.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
               .groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                   F.struct("_rn", "url"))), lambda s: F.concat(F.lit("- "), s["url"])), "\n").alias("first_urls")))
    cnt = urls.groupBy("job_id").agg(F.count(F.lit(1)).alias("page_count"))
    return cnt.join(top, "job_id")


def split_row_number(df: DataFrame, key, ts: str, tie: str, unit: str = "month",
                     descending: bool = False, bucket_col: str | None = None, total: str | None = None) -> DataFrame:
    """``row_number()`` over (key ordered by ts, tie) without sending a key's
    rows to one task: rows are counted per (key, time bucket) with a map-side
    aggregate, the bucket counts get a running sum per key (one row per bucket),
    and the number inside a bucket is a window over (key, bucket) only.
    ``bucket_col`` orders by that column first (e.g. url) and uses its values
    as the buckets instead of time truncated to ``unit``. ``total`` names a column
    for the number of the key's rows, from the same bucket counts."""
    keys = [key] if isinstance(key, str) else list(key)
    b = F.col(bucket_col) if bucket_col else F.date_trunc(unit, F.col(ts))
    d = df.withColumn("_b", b)
    per = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    border = F.col("_b").desc() if descending else F.col("_b").asc()
    before = Window.partitionBy(*keys).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    every = [F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []
    offsets = per.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), *every)
    o = [F.col(ts).desc(), F.col(tie).desc()] if descending else [F.col(ts).asc(), F.col(tie).asc()]
    inside = Window.partitionBy(*keys, "_b").orderBy(*o)
    return (d.withColumn("_in", F.row_number().over(inside)).join(offsets, [*keys, "_b"])
             .withColumn("rn", (F.col("_off") + F.col("_in")).cast("long")).drop("_b", "_in", "_off"))


def version_history(versions: DataFrame) -> DataFrame:                             # E12
    """Every version with its page's true version count and its rank (newest
    first), both from the bucket counts of ``split_row_number``."""
    ranked = split_row_number(versions.select("page_id", "id", "created_at"), "page_id", "created_at", "id",
                              descending=True, total="version_count")
    return ranked.select("page_id", "id", "created_at", "version_count", F.col("rn").alias("version_rank"))


# ---- R: integrity -----------------------------------------------------------------------

def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:                    # R1
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str = "id") -> DataFrame:  # R2
    return child.filter(F.col(fk).isNotNull()).join(
        parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def job_status_view(jobs: DataFrame, versions: DataFrame, artifacts: DataFrame) -> DataFrame:   # D3
    """Per job: D1 counts, duration text (J7; NULL while running or when it
    rounds to 0) and the job's artifacts, newest first."""
    from ..functions.scalars import duration_text
    counts = version_counts(versions)
    arts = artifacts.groupBy("job_id").agg(F.sort_array(F.collect_list(
        F.struct("created_at", "id", "kind", "version")), asc=False).alias("artifacts"))
    j = jobs.select(F.col("id").alias("job_id"), "domain_id", "type", "status", "started_at", "finished_at")
    return (j.join(counts, "job_id", "left").join(arts, "job_id", "left")
             .select("job_id", "domain_id", "type", "status",
                     duration_text(F.col("started_at"), F.col("finished_at")).alias("duration"),
                     F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("changed", F.lit(0)).alias("changed"),
                     F.coalesce("skipped", F.lit(0)).alias("skipped"), "artifacts"))


def profiles_ordered(profiles: DataFrame) -> DataFrame:                            # E10
    """Profiles by version desc, created_at desc (a distributed sort; no
    global row numbering through one task)."""
    return (profiles.select("id", "name", "version", "created_at")
                    .orderBy(F.col("version").desc(), F.col("created_at").desc(), F.col("id")))


def cascade_delete_jobs(jobs: DataFrame, versions: DataFrame, artifacts: DataFrame,
                        doomed: DataFrame, pages: DataFrame | None = None) -> dict[str, DataFrame]:  # R3
    """Deleting jobs cascades to their page versions and artifacts, and to the
    pages (page_id, job_id) last seen by them, whose versions go too, whatever
    job they are from. ``doomed``: job ids. Returns the remaining tables; each
    is a ``left_anti`` rewrite."""
    d = doomed.select(F.col("id").alias("job_id")).distinct()
    keep_jobs = jobs.join(d.withColumnRenamed("job_id", "id"), "id", "left_anti")
    keep_versions = versions.join(d, "job_id", "left_anti")
    out = {"jobs": keep_jobs, "versions": keep_versions, "artifacts": artifacts.join(d, "job_id", "left_anti")}
    if pages is not None:
        out["pages"] = pages.join(d, "job_id", "left_anti")
        out["versions"] = keep_versions.join(pages.join(d, "job_id", "left_semi").select("page_id"), "page_id", "left_anti")
    return out


def delete_profiles(domains: DataFrame, doomed_profiles: DataFrame) -> DataFrame:  # R3 (set null)
    """Deleting a profile sets the domains' profile reference to NULL."""
    d = doomed_profiles.select(F.col("id").alias("_pid"), F.lit(True).alias("_gone"))
    x = domains.join(d, domains.profile_id == d._pid, "left")
    return x.withColumn("profile_id", F.when(F.col("_gone").isNull(), F.col("profile_id"))).drop("_pid", "_gone")


def deletable_domains(domains: DataFrame, jobs: DataFrame) -> DataFrame:           # R3 (restrict)
    """A domain with jobs cannot be deleted (restricted foreign key)."""
    return domains.join(jobs.select(F.col("domain_id").alias("id")).distinct(), "id", "left_anti")
