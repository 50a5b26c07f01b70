"""Scalar column functions (J1-J11, url helpers).

All of these are built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Host of an absolute url: scheme, optional user info, then up to '/', '?', '#' or ':'.
HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?([^/?#:]*)"
# Path of an absolute url ('' when the url has none).
PATH_PATTERN = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def url_host(url) -> Column:
    """Lower-cased host of an absolute url, NULL when there is none."""
    h = F.regexp_extract(_c(url), HOST_PATTERN, 1)
    return F.when(h != "", F.lower(h))


def url_path(url) -> Column:
    """Path of an absolute url; NULL when the text is not an absolute url."""
    u = _c(url)
    return F.when(u.rlike(HOST_PATTERN), F.regexp_extract(u, PATH_PATTERN, 1))


def normalize_domain(url) -> Column:
    """Strip scheme, ``www.``, one trailing '/', keep text before the first '/'."""
    s = F.regexp_replace(_c(url), r"^https?://", "")
    s = F.regexp_replace(s, r"^www\.", "")
    s = F.regexp_replace(s, r"/$", "")  # Java '$' also matches before a final '\n'
    return F.split(s, "/", -1).getItem(0)


def crawl_domain_valid(norm) -> Column:
    """J1 validation: non-empty and contains a '.'."""
    n = _c(norm)
    return (n != "") & n.contains(".")


def hostname(text) -> Column:
    """Trim, lower, add https:// when no scheme, take the host; text as is
    when no host can be parsed."""
    t = F.lower(js_trim(_c(text)))
    t = F.when(t.startswith("http://") | t.startswith("https://"), t).otherwise(F.concat(F.lit("https://"), t))
    h = F.regexp_extract(t, r"^https?://(?:[^@/?#]*@)?([^/?#:]*)", 1)
    return F.when((h != "") & ~h.contains(" "), h).otherwise(t)


def sanitize_url(url) -> Column:
    """Drop the scheme, every non-alphanumeric -> '_', lower case."""
    s = F.regexp_replace(_c(url), r"^https?://", "")
    return F.lower(F.regexp_replace(s, r"[^a-zA-Z0-9]", "_"))


def date_for_path(ts) -> Column:
    """J4 date part: ``mon_d_yyyy_HH_mm`` (UTC session zone)."""
    t = _c(ts)
    return F.concat_ws("_", F.lower(F.date_format(t, "MMM")), F.date_format(t, "d"),
                       F.date_format(t, "yyyy"), F.date_format(t, "HH"), F.date_format(t, "mm"))


def job_folder(job_id, started_at) -> Column:
    """J4 job folder: date part + '_' + id text before the first '-'."""
    short = F.split(_c(job_id).cast("string"), "-", -1).getItem(0)
    return F.concat(date_for_path(started_at), F.lit("_"), short)


def artifact_path(domain, job_id, started_at, kind) -> Column:
    """Path of a job document; kind 'llms_txt' or 'llms_full_txt'."""
    fname = F.when(_c(kind) == "llms_txt", F.lit("llms.txt")).otherwise(F.lit("llms-full.txt"))
    return F.concat(F.lit("domains/"), sanitize_url(domain), F.lit("/jobs/"),
                    job_folder(job_id, started_at), F.lit("/"), fname)


def page_path(domain, job_id, started_at, page_url, suffix: str) -> Column:
    """Path of a stored page text; suffix 'raw' or 'processed'."""
    return F.concat(F.lit("domains/"), sanitize_url(domain), F.lit("/jobs/"),
                    job_folder(job_id, started_at), F.lit("/pages/"), sanitize_url(page_url),
                    F.lit(f"_{suffix}.md"))


def human_minutes(minutes) -> Column:
    """J5: '1 day, 2 hours, 5 minutes' with singular forms; 0 -> '0 minutes'."""
    m = _c(minutes).cast("long")
    days = F.floor(m / 1440)
    hours = F.floor((m % 1440) / 60)
    mins = m % 60

    def part(v, one, many):
        return F.when(v > 0, F.concat(v.cast("string"), F.when(v == 1, F.lit(one)).otherwise(F.lit(many))))

    joined = F.concat_ws(", ", part(days, " day", " days"), part(hours, " hour", " hours"),
                         part(mins, " minute", " minutes"))
    return F.when(m == 0, F.lit("0 minutes")).otherwise(joined)


def max_age_ms(minutes) -> Column:
    """max(0, minutes * 60000)."""
    return F.greatest(F.lit(0).cast("long"), _c(minutes).cast("long") * 60000)


def js_round(x) -> Column:
    """Math.round: half rounds towards +infinity."""
    return F.floor(_c(x) + F.lit(0.5))


def duration_text(started_at, finished_at) -> Column:
    """Whole seconds between two timestamps + 's'; NULL while running or
    when it rounds to 0."""
    ms = F.unix_millis(F.to_timestamp(_c(finished_at))) - F.unix_millis(F.to_timestamp(_c(started_at)))
    secs = js_round(ms / 1000.0).cast("long")
    return F.when(_c(finished_at).isNotNull() & (secs != 0), F.concat(secs.cast("string"), F.lit("s")))


def storage_url(base: str, path, bucket: str = "artifacts") -> Column:
    """Base + public object prefix + bucket + path."""
    return F.concat(F.lit(f"{base}/storage/v1/object/public/{bucket}/"), _c(path))


def json_merge(left, right) -> Column:
    """Shallow merge of two JSON objects, right side wins (``{...a, ...b}``):
    keys keep their first position, new keys follow; values keep their JSON
    types. Values are read as VARIANT; the key order comes from a map parse
    (a VARIANT object sorts its keys). A missing or non-object side is {}."""
    vt, st = "map<string,variant>", "map<string,string>"

    def side(c):
        return F.struct(F.coalesce(F.map_keys(F.from_json(_c(c), st)), F.array().cast("array<string>")).alias("k"),
                        F.coalesce(F.try_parse_json(_c(c)).try_cast(vt), F.create_map().cast(vt)).alias("v"))

    def merge(pair):
        lv, rk, rv = pair["l"]["v"], pair["r"]["k"], pair["r"]["v"]
        keys = F.array_union(pair["l"]["k"], rk)
        vals = F.transform(keys, lambda k: F.when(F.array_contains(rk, k), F.element_at(rv, k))
                           .otherwise(F.element_at(lv, k)))
        return F.to_json(F.map_from_arrays(keys, vals))
    # bind both parsed sides once (one-element transform) before the per-key lambda
    return F.element_at(F.transform(F.array(F.struct(side(left).alias("l"), side(right).alias("r"))), merge), 1)


def title_case_slug(slug) -> Column:
    """J10: 'getting-started' -> 'Getting Started' (rest of each word unchanged)."""
    words = F.split(_c(slug), "-", -1)
    cap = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    return F.array_join(cap, " ")


def path_page_type(path) -> Column:
    """J11: '/' -> homepage, contains /docs -> documentation, /blog -> blog, else product."""
    p = _c(path)
    return (F.when(p == "/", "homepage").when(p.contains("/docs"), "documentation")
            .when(p.contains("/blog"), "blog").otherwise("product"))


# JavaScript's String.prototype.trim removes these (fixed set: ASCII white space,
# line terminators, no-break and Unicode space separators, byte order mark).
JS_WHITESPACE = ("\t\n\u000b\u000c\r \u00a0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_trim(col) -> Column:
    """String.prototype.trim: Spark's ``trim`` strips only spaces."""
    return F.btrim(_c(col), F.lit(JS_WHITESPACE))


def path_category(url) -> Column:
    """First non-empty path segment of the url; 'root' when there is none;
    'other' when the text is not an absolute url."""
    segs = F.filter(F.split(url_path(url), "/", -1), lambda s: s != "")
    first = F.try_element_at(segs, F.lit(1))
    return F.when(url_path(url).isNull(), F.lit("other")).otherwise(F.coalesce(first, F.lit("root")))


def last_url_segment(url) -> Column:
    """``url.split('/').pop()``: text after the last '/'."""
    return F.element_at(F.split(_c(url), "/", -1), -1)
