"""Crawl webhook events: raw payloads, parsing and routing.

A payload is ``{"type", "id", "data"}`` where ``data`` is an array of page
documents for ``crawl.page`` and an object for completion / failure. The
envelope is parsed once with ``data`` kept as raw JSON text, then each type's
``data`` is parsed with its own schema; malformed payloads and unknown types
go to a quarantine instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KNOWN_TYPES = ["crawl.started", "crawl.page", "crawl.completed", "crawl.failed"]

ENVELOPE = T.StructType([T.StructField("type", T.StringType()), T.StructField("id", T.StringType()),
                         T.StructField("data", T.StringType())])
PAGE_DOCS = ("array<struct<markdown:string,metadata:map<string,string>,"
             "changeTracking:map<string,string>>>")
COMPLETION = "struct<pagesScraped:int,totalPages:int,creditsUsed:int,error:string>"


# ----------------------------------------------------------------------------- derived raw log

def webhook_payloads(events: DataFrame) -> DataFrame:
    """Raw webhook log (event_id, ts, payload) derived from flat crawl events.

    Fixed spelling rules: page events carry one document whose metadata url is
    the page url; sourceURL is '' when event_id % 3 = 0, the url + '?src' when
    event_id % 5 = 0 (else the url); event_id % 11 = 0 adds a second document
    with only a metadata url (url + '/more') and no markdown. Completions carry
    pagesScraped = floor(value); failures an error text. event_id % 97 = 0 is
    an unknown type 'crawl.paused'; event_id % 89 = 0 is cut-off JSON."""
    e = F.col("event_id")
    k = F.regexp_extract(F.col("url"), r"/docs/(.*)$", 1)
    src = (F.when(e % 3 == 0, F.lit("")).when(e % 5 == 0, F.concat(F.col("url"), F.lit("?src")))
           .otherwise(F.col("url")))
    meta = F.create_map(F.lit("sourceURL"), src, F.lit("url"), F.col("url"),
                        F.lit("title"), F.concat(F.lit("Page "), k), F.lit("scrapeId"), F.col("scrape_id"))
    doc1 = F.struct(F.concat(F.lit("# Page "), k, F.lit("\n\nBody of page "), k).alias("markdown"), meta.alias("metadata"))
    doc2 = F.struct(F.lit(None).cast("string").alias("markdown"),
                    F.create_map(F.lit("url"), F.concat(F.col("url"), F.lit("/more"))).alias("metadata"))
    page_data = F.to_json(F.when(e % 11 == 0, F.array(doc1, doc2)).otherwise(F.array(doc1)))
    data = (F.when(F.col("type") == "crawl.page", page_data)
            .when(F.col("type") == "crawl.completed",
                  F.to_json(F.struct(F.floor("value").cast("int").alias("pagesScraped"))))
            .when(F.col("type") == "crawl.failed", F.lit('{"error":"timeout"}'))
            .otherwise(F.lit("[]")))
    typ = F.when(e % 97 == 0, F.lit("crawl.paused")).otherwise(F.col("type"))
    head = F.to_json(F.struct(typ.alias("type"), F.col("external_id").alias("id")))
    # '{"type":..,"id":..}' -> '{"type":..,"id":..,"data":<data>}'
    payload = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"data":'), data, F.lit("}"))
    payload = F.when(e % 89 == 0, F.substring(payload, 1, 25)).otherwise(payload)
    return events.withColumn("_head", head).select("event_id", "ts", payload.alias("payload"))


# ----------------------------------------------------------------------------- A1

LOG_SCHEMA = "event_id long, ts timestamp_ntz, payload string"
LOG_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # microseconds (the JSON default keeps milliseconds)


def write_webhook_log(log: DataFrame, path: str) -> None:
    log.write.mode("overwrite").option("timestampNTZFormat", LOG_TS_FORMAT).json(path)


def read_webhook_log(spark, path: str) -> DataFrame:
    """A1 batch source: JSON-lines webhook log with a fixed schema (no
    inference pass over the data); malformed lines become NULL payloads and
    are routed to the quarantine by ``parse_webhooks``."""
    return (spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE")
            .option("timestampNTZFormat", LOG_TS_FORMAT).json(path))


def parse_webhooks(raw: DataFrame, col: str = "payload") -> DataFrame:
    """A1: envelope parse + routing status: accepted / unknown_type / corrupt.

    The envelope is parsed inside a generator (``inline`` of a one-element
    array): predicates on the parsed fields then stay above the parse instead
    of being pushed below it with the JSON parse copied into each condition,
    so each payload is parsed exactly once."""
    keep = [c for c in raw.columns if c != col]
    p = raw.select(*keep, F.inline(F.array(F.from_json(F.col(col), ENVELOPE))))
    status = (F.when(F.col("type").isNull(), F.lit("corrupt"))
              .when(F.col("type").isin(KNOWN_TYPES), F.lit("accepted"))
              .otherwise(F.lit("unknown_type")))
    return p.select(*keep, "type", F.col("id").alias("external_id"), "data", status.alias("status"))


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("status") != "accepted")


# ----------------------------------------------------------------------------- A2 / D9

def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in cols], F.lit(""))


def explode_pages(parsed: DataFrame) -> DataFrame:
    """A2: one row per document of an accepted crawl.page event; url is the
    first non-empty of metadata.sourceURL, metadata.url, ''; markdown
    defaults to ''."""
    pages = parsed.filter((F.col("status") == "accepted") & (F.col("type") == "crawl.page"))
    docs = F.from_json(F.col("data"), PAGE_DOCS)
    x = pages.select(*[c for c in parsed.columns if c not in ("data", "status")],
                     F.posexplode(docs).alias("doc_pos", "_d"))
    md = F.col("_d.metadata")
    return x.select(*[c for c in x.columns if c != "_d"],
                    first_nonempty(md["sourceURL"], md["url"]).alias("url"),
                    F.coalesce(F.col("_d.markdown"), F.lit("")).alias("markdown"),
                    md["title"].alias("title"), md["scrapeId"].alias("scrape_id"))


def explode_steps(parsed: DataFrame) -> DataFrame:
    """Page documents (as ``explode_pages``) and completion rows (url NULL,
    doc_pos 0) from one generator over the accepted events, so the log is
    read and parsed once for both."""
    ok = parsed.filter((F.col("status") == "accepted") & F.col("type").isin("crawl.page", "crawl.completed"))
    docs = F.from_json(F.col("data"), PAGE_DOCS)
    close = F.array(F.struct(F.lit(None).cast("string").alias("markdown"),
                             F.lit(None).cast("map<string,string>").alias("metadata"),
                             F.lit(None).cast("map<string,string>").alias("changeTracking")))
    items = F.when(F.col("type") == "crawl.page", docs).otherwise(close)
    x = ok.select(*[c for c in parsed.columns if c not in ("data", "status")],
                  F.posexplode(items).alias("doc_pos", "_d"))
    md = F.col("_d.metadata")
    is_page = F.col("type") == "crawl.page"
    return x.select(*[c for c in x.columns if c != "_d"],
                    F.when(is_page, first_nonempty(md["sourceURL"], md["url"])).alias("url"),
                    F.when(is_page, F.coalesce(F.col("_d.markdown"), F.lit(""))).alias("markdown"),
                    md["title"].alias("title"), md["scrapeId"].alias("scrape_id"))


def event_tally(parsed: DataFrame) -> DataFrame:
    """Documents per page event, pages scraped per completion."""
    ok = parsed.filter(F.col("status") == "accepted")
    docs = F.size(F.from_json(F.col("data"), PAGE_DOCS))
    comp = F.from_json(F.col("data"), COMPLETION)
    return ok.select(*[c for c in parsed.columns if c not in ("data", "status")],
                     F.when(F.col("type") == "crawl.page", docs).alias("document_count"),
                     F.when(F.col("type") == "crawl.completed",
                            F.coalesce(comp["pagesScraped"], F.lit(0))).alias("pages_scraped"),
                     F.when(F.col("type") == "crawl.failed",
                            F.coalesce(comp["error"], F.lit("Unknown error"))).alias("error"))
