"""Engine tables derived from the given tables.

The given tables hold no crawl history, so the engine tables (domain, job,
page version, artifact, profile, version chain, crawled page, crawl event) are
derived from them by fixed rules. Every rule is a plain column expression or a
join on a key, so the derived tables grow with the inputs and the same rule is
written once more as SQL in ``sitegrove.plans.oracle`` for the DuckDB check.

Rules (fixed; shared with the SQL oracle):

* domain   <- customer: id = c_custkey, domain = 'site' || id || '.example.com',
  interval = 60 * (1 + id % 48) minutes, active = c_acctbal >= 0,
  profile_id = c_nationkey unless c_nationkey % 4 = 3 (then NULL),
  model = 'model-' || c_mktsegment (lower case), created_at 2020-01-01 + id % 365 days,
  updated_at = created_at + c_nationkey days.
* job      <- orders: id = o_orderkey, domain_id = o_custkey, started_at = o_orderdate,
  status F/O/P -> finished/processing/failed, finished_at = started_at + (id % 600)
  minutes unless processing, type initial for priority '1-URGENT' else update,
  external_id = 'crawl-' || id.
* page version (statistics) <- lineitem: id = l_orderkey * 8 + l_linenumber,
  job_id = l_orderkey, page_id = l_partkey,
  importance = NULL if l_linenumber % 5 = 0 else l_linenumber % 5,
  created_at = l_shipdate, change_status by l_returnflag N/R/A -> same/changed/new.
  Page url (only when asked, needs the job's domain): 'https://' || domain ||
  path(l_partkey % 12) || '/' || l_partkey with the twelve site paths below.
* artifact <- finished jobs x two kinds, version = row_number over (domain, kind
  order by started_at, id), created_at = finished_at (+1 s for the full document).
* profile  <- nation: id = n_nationkey, version = 1 + id % 3.
* version chain <- conversations: page = conv_id, order = turn, text = text; the
  recrawled chain has each of its versions three times in a row.
* crawled page <- pages: url, html as raw markdown, domain = host of url.
* crawl event <- events: job = user_id; signup/view/click/purchase/error ->
  crawl.started/crawl.page/crawl.page/crawl.completed/crawl.failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import raw_table, read_table, tasks_for

# Site paths of the derived pages.
SITE_PATHS = ["/", "/docs", "/docs/install", "/docs/reference", "/docs/recipes", "/blog", "/blog/release-notes",
              "/blog/field-report", "/catalog", "/pricing", "/about", "/press"]

ARTIFACT_KINDS = ["llms_txt", "llms_full_txt"]


def domain_name(custkey: Column) -> Column:
    return F.concat(F.lit("site"), custkey.cast("string"), F.lit(".example.com"))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    created = F.expr("timestampadd(DAY, CAST(c_custkey % 365 AS INT), TIMESTAMP_NTZ '2020-01-01 00:00:00')")
    return c.select(
        F.col("c_custkey").alias("id"),
        domain_name(F.col("c_custkey")).alias("domain"),
        (F.lit(60) * (F.lit(1) + F.col("c_custkey") % 48)).cast("int").alias("check_interval_minutes"),
        F.concat(F.lit("model-"), F.lower("c_mktsegment")).alias("model"),
        F.when(F.col("c_nationkey") % 4 == 3, F.lit(None).cast("int"))
         .otherwise(F.col("c_nationkey")).alias("profile_id"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        created.alias("created_at"),
        F.expr("timestampadd(DAY, c_nationkey, timestampadd(DAY, CAST(c_custkey % 365 AS INT), "
               "TIMESTAMP_NTZ '2020-01-01 00:00:00'))").alias("updated_at"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", "finished")
              .when(F.col("o_orderstatus") == "O", "processing")
              .when(F.col("o_orderstatus") == "P", "failed"))
    finished = F.when(F.col("o_orderstatus") != "O",
                      F.expr("timestampadd(MINUTE, CAST(o_orderkey % 600 AS INT), o_orderdate)"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("domain_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "initial").otherwise("update").alias("type"),
        status.alias("status"),
        F.concat(F.lit("crawl-"), F.col("o_orderkey").cast("string")).alias("external_id"),
        F.col("o_orderdate").alias("started_at"),
        finished.alias("finished_at"),
    )


def _version_columns(lineitem: DataFrame, *more: str) -> DataFrame:
    imp = F.when(F.col("l_linenumber") % 5 == 0, F.lit(None)).otherwise(F.col("l_linenumber") % 5)
    return lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_partkey").alias("page_id"),
        F.col("l_orderkey").alias("job_id"),
        F.when(F.col("l_returnflag") == "N", "same").when(F.col("l_returnflag") == "R", "changed")
         .otherwise("new").alias("change_status"),
        imp.cast("smallint").alias("importance"),
        F.col("l_shipdate").alias("created_at"),
        *more,
    )


def _page_url() -> Column:
    paths = F.array(*[F.lit(p.rstrip("/")) for p in SITE_PATHS])
    return F.concat(F.lit("https://"), domain_name(F.col("domain_id")),
                    F.element_at(paths, (F.col("page_id") % 12 + 1).cast("int")),
                    F.lit("/"), F.col("page_id").cast("string"))


def page_versions(spark: SparkSession, sf_dir: str, with_page: bool = False) -> DataFrame:
    """Page-version statistics table. ``with_page`` adds domain_id and url,
    which needs the job's domain (a join with orders on the job key)."""
    v = _version_columns(read_table(spark, sf_dir, "lineitem"))
    if not with_page:
        return v
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("domain_id"))
    return v.join(o, "job_id").withColumn("url", _page_url())


def job_page_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_versions`` with pages for what is worked on job by job: the rows come
    dealt by job over as many tasks as their number asks for, so aggregates,
    windows and joins by job follow without another shuffle."""
    li = raw_table(spark, sf_dir, "lineitem")
    n = tasks_by_job(spark, sf_dir)
    o = raw_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("domain_id"))
    v = _version_columns(li).repartition(n, "job_id").join(o.repartition(n, "job_id"), "job_id")
    return v.withColumn("url", _page_url())


def _with_texts(v: DataFrame) -> DataFrame:
    """The display fields of versions that have their part's columns."""
    li_line = (F.col("id") % 8)
    return v.withColumns({
        "title": F.when(li_line % 4 == 0, F.lit("")).otherwise(F.col("p_name")),
        "description": F.when(li_line % 3 == 0, F.lit(None)).otherwise(F.col("p_type")),
        "summary": F.when(li_line % 2 == 0, F.concat(F.col("p_name"), F.lit(" by "), F.col("p_brand")))})


def page_version_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page versions with display fields: title/description/summary from part."""
    v = page_versions(spark, sf_dir, with_page=True)
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return _with_texts(v.join(p, v.page_id == p.p_partkey)).select(
        "id", "page_id", "job_id", "domain_id", "url", "change_status", "importance", "created_at",
        "title", "description", "summary")


def tasks_by_job(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks page versions are dealt over by job."""
    li = raw_table(spark, sf_dir, "lineitem")
    return tasks_for(li, li.count())


def job_page_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_version_details`` with the domain's name, for what is worked on job by
    job. Versions meet their part as the table's own narrow rows and jobs their domain,
    then both meet once, dealt by job as in ``job_page_versions``; what is made of
    those rows is made after that."""
    li = raw_table(spark, sf_dir, "lineitem")
    n = tasks_by_job(spark, sf_dir)
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    v = li.join(p, li.l_partkey == p.p_partkey).repartition(n, "l_orderkey")
    o = raw_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("domain_id"))
    j = o.join(domains(spark, sf_dir).select(F.col("id").alias("domain_id"), "domain"), "domain_id")
    v = _version_columns(v, "p_name", "p_type", "p_brand")
    d = v.join(j.repartition(n, "job_id"), "job_id").withColumn("url", _page_url())
    return _with_texts(d).select("id", "page_id", "job_id", "domain_id", "domain", "url", "change_status", "importance",
                                 "created_at", "title", "description", "summary")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.catalog import split_row_number
    j = jobs(spark, sf_dir).filter(F.col("status") == "finished")
    kinds = F.explode(F.array(*[F.lit(k) for k in ARTIFACT_KINDS])).alias("kind")
    a = j.select("id", "domain_id", "started_at", "finished_at", kinds)
    # version = position in (domain, kind) by (started_at, id), numbered without
    # sending a domain's whole history to one task
    a = split_row_number(a, ["domain_id", "kind"], "started_at", "id", unit="year")
    return a.select(
        (F.col("id") * 2 + F.when(F.col("kind") == "llms_txt", 0).otherwise(1)).alias("id"),
        F.col("id").alias("job_id"),
        F.col("domain_id"),
        F.col("kind"),
        F.col("rn").cast("int").alias("version"),
        F.when(F.col("kind") == "llms_txt", F.col("finished_at"))
         .otherwise(F.expr("timestampadd(SECOND, 1, finished_at)")).alias("created_at"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").alias("id"),
        F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 2 == 0,
               F.concat(F.lit("Summarize pages for readers in "), F.col("n_name")))
         .alias("summary_prompt"),
        F.concat(F.lit("# "), F.col("n_name")).alias("header"),
        F.lit("{{header}}\n\nDate: {{date}}\nDomain: {{domain}}\n\n{{domainSummary}}\n\n{{pageSummaries}}")
         .alias("template"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit('{"similarityThreshold": 0.85}'))
         .otherwise(F.lit("{}")).alias("params"),
        (F.lit(1) + F.col("n_nationkey") % 3).cast("int").alias("version"),
        F.expr("timestampadd(DAY, n_regionkey, TIMESTAMP_NTZ '2023-01-01 00:00:00')").alias("created_at"),
    )


def _chain_id() -> Column:
    """One number for each (conversation, turn), for any number of turns."""
    return F.expr("(conv_id + turn) * (conv_id + turn + 1) div 2 + turn")


def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    return c.select(_chain_id().alias("id"),
                    F.col("conv_id").alias("page_id"), F.col("turn").alias("seq"), F.col("text"))


# Scorer response spellings used to derive the response table
# (valid, padded, with trailing words, out of range, words, missing).
SCORER_RESPONSES = [" 3 ", "4", "1", "2 (moderate)", "high", "9", None]


def scorer_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-score responses keyed by chain version id (versions after the
    first), spelled by (conv_id + turn) % 7 from the list above."""
    c = read_table(spark, sf_dir, "conversations").filter(F.col("turn") > 0)
    resp = F.element_at(F.array(*[F.lit(r).cast("string") for r in SCORER_RESPONSES]),
                        ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int"))
    return c.select(_chain_id().alias("id"), resp.alias("response"))


def recrawl_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version chain with every version crawled three times in a row."""
    again = F.explode(F.array(*map(F.lit, range(3)))).alias("_k")
    c = version_chain(spark, sf_dir).select("*", again)
    return c.select((F.col("id") * 3 + F.col("_k")).alias("id"), "page_id", (F.col("seq") * 3 + F.col("_k")).alias("seq"), "text")


def recrawl_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-score responses of the recrawled chain, by (page_id + seq) % 7."""
    resp = F.element_at(F.array(*[F.lit(r).cast("string") for r in SCORER_RESPONSES]), ((F.col("page_id") + F.col("seq")) % 7 + 1).cast("int"))
    return recrawl_chain(spark, sf_dir).select("id", resp.alias("response"))


def crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalars import url_host
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", "url", url_host(F.col("url")).alias("domain"),
                    F.col("html").alias("raw_md"))


EVENT_TYPES = {"signup": "crawl.started", "view": "crawl.page", "click": "crawl.page",
               "purchase": "crawl.completed", "error": "crawl.failed"}


def crawl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat crawl events: one row per delivery (page events carry one url)."""
    e = read_table(spark, sf_dir, "events")
    etype = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_TYPES.items()])
    k = F.get_json_object(F.col("props"), "$.k")
    return e.select(
        F.col("event_id"),
        F.col("user_id").alias("job_id"),
        F.concat(F.lit("crawl-"), F.col("user_id").cast("string")).alias("external_id"),
        etype.alias("type"),
        F.col("ts"),
        F.col("value"),
        F.when(etype == "crawl.page",
               F.concat(F.lit("https://"), domain_name(F.col("user_id")), F.lit("/docs/"), k)).alias("url"),
        F.when(etype == "crawl.page",
               F.concat(F.col("user_id").cast("string"), F.lit("-"), k)).alias("scrape_id"),
    )


def crawl_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl requests: re-crawl requests for known domains (one for each order,
    url spelled four ways, one of them invalid) unioned with first-time requests
    for the crawled pages' urls."""
    o = read_table(spark, sf_dir, "orders")
    name = domain_name(F.col("o_custkey"))
    k = F.col("o_orderkey") % 4
    url = (F.when(k == 0, F.concat(F.lit("https://www."), name, F.lit("/")))
           .when(k == 1, F.concat(F.lit("http://"), name, F.lit("/docs")))
           .when(k == 2, name)
           .otherwise(F.lit("https://localhost/")))
    known = o.select(F.col("o_orderkey").alias("request_id"), url.alias("url"),
                     F.expr("timestampadd(MINUTE, CAST(o_orderkey % 1440 AS INT), o_orderdate)").alias("requested_at"))
    p = read_table(spark, sf_dir, "pages")
    fresh = p.select((-(F.col("page_id") + 1)).alias("request_id"), F.col("url"),
                     F.expr("timestampadd(MINUTE, CAST(page_id AS INT), TIMESTAMP_NTZ '2024-01-15 00:00:00')")
                      .alias("requested_at"))
    return known.unionByName(fresh)
