"""Registered assembly and request/response queries (I, C6, D7, H) with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import AS_OF
from ..functions import prompts as H
from ..operators import assemble as A
from ..session import stored
from ..sources import derived as D
from ..sources.tables import read_table
from . import sqlfrag as Q
from .q_changes import diff_text_sql
from .registry import register
from .sqlviews import with_views

ISO = A.iso_millis(AS_OF)
NL = "chr(10)"
NN = "chr(10) || chr(10)"


def _with_domain(spark, sf, versions):
    """Attach the domain name by the version's domain key (a join with the
    small domain dimension; AQE broadcasts it once measured)."""
    d = D.domains(spark, sf).select(F.col("id").alias("domain_id"), "domain")
    return versions.join(d, "domain_id")


def _details(spark, sf):
    return D.job_page_details(spark, sf).select(
        "job_id", "domain", "id", "url", "title", "description", "summary", "created_at")


def _lit(text: str) -> str:
    """A Python string as a SQL string expression (quotes doubled, new lines as chr(10))."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _nz(e: str) -> str:
    return f"coalesce({e}, '') <> ''"


def _title_sql(last: str) -> str:
    seg = Q.last_segment("v.url")
    return f"(CASE WHEN {_nz('v.title')} THEN v.title WHEN {_nz(seg)} THEN {seg} ELSE '{last}' END)"


_V = with_views("d_version_detail", "d_job", "d_domain") + """
, v AS (SELECT vd.job_id, vd.id, vd.url, vd.title, vd.description, vd.summary, vd.created_at, d.domain
        FROM d_version_detail vd JOIN d_job j ON j.id = vd.job_id JOIN d_domain d ON d.id = j.domain_id)"""


@register("assembly_gate", "I1", sql=with_views("d_version") + """
SELECT job_id, count(*) AS versions,
       count(*) FILTER (WHERE importance IS NULL OR importance >= 2) AS changed,
       NOT ((bool_and(coalesce(change_status = 'same', false)) AND count(*) > 0)
            OR count(*) FILTER (WHERE importance IS NULL OR importance >= 2) = 0) AS should_generate,
       CASE WHEN bool_and(coalesce(change_status = 'same', false)) AND count(*) > 0 THEN 'all pages unchanged'
            WHEN count(*) FILTER (WHERE importance IS NULL OR importance >= 2) = 0 THEN 'no significantly changed pages'
       END AS skipped_reason
FROM d_version GROUP BY job_id""")
def q_gate(spark, sf):
    return A.assembly_gate(D.page_versions(spark, sf))


_SECTION2 = (f"'## ' || {_title_sql('page')} || {NL} || '> ' || CASE WHEN {_nz('v.description')} THEN v.description "
             f"ELSE 'Content from ' || v.domain END || {NN} || 'URL: ' || v.url || {NL} || "
             f"CASE WHEN {_nz('v.summary')} THEN {NL} || v.summary || {NL} ELSE '' END")


_INDEX_SELECT = f"""
SELECT job_id, domain, count(*) AS pages,
       '# ' || domain || {NN} || 'AI-readable content extracted from ' || domain || {NN} || {NL}
         || 'Generated: {ISO}' || {NL} || 'Pages processed: ' || CAST(count(*) AS VARCHAR) || {NL} || {NL}
         || '---' || {NL} || {NL} || string_agg({_SECTION2}, {NL} ORDER BY v.url, v.created_at, v.id) AS content
FROM v GROUP BY job_id, domain"""


@register("index_documents", "I2,I7", sql=_V + _INDEX_SELECT)
def q_index_documents(spark, sf):
    return A.index_document(_details(spark, sf), AS_OF)


_SECTION3 = (f"'### ' || {_title_sql('Page')} || {NN} || CASE WHEN {_nz('v.summary')} THEN v.summary || {NN} "
             f"WHEN {_nz('v.description')} THEN '> ' || v.description || {NN} ELSE '' END || '---' || {NN}")
_ANCHOR = Q.rx("lower(category)", r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+", "'-'")
_IS_INDEX = "(regexp_full_match(category, '(0|[1-9][0-9]{0,9})') AND TRY_CAST(category AS BIGINT) < 4294967295)"


def _full_doc_sql(pages_cte: str) -> str:
    return _V + f"""
, fs AS (SELECT job_id, url, {_SECTION3} AS section FROM v
         QUALIFY row_number() OVER (PARTITION BY job_id, url ORDER BY created_at, id) = 1)
{pages_cte}
, pc AS (SELECT pg.job_id, pg.category, count(*) AS n, min(pg.pos) AS first_pos,
                '## ' || pg.category || {NN} || string_agg(fs.section, '' ORDER BY pg.pos) AS block
         FROM pg JOIN fs ON fs.job_id = pg.job_id AND fs.url = pg.url GROUP BY pg.job_id, pg.category)
, pk AS (SELECT *, NOT {_IS_INDEX} AS k1, CASE WHEN {_IS_INDEX} THEN TRY_CAST(category AS BIGINT) END AS k2,
                '- [' || category || '](#' || {_ANCHOR} || ') (' || CAST(n AS VARCHAR) || ' pages)' AS toc FROM pc)
, doc AS (SELECT pk.job_id, count(*) AS categories,
                 '# ' || any_value(d.domain) || ' - Complete Documentation' || {NN} || '> Comprehensive content archive from '
                   || any_value(d.domain) || {NN} || 'Generated: {ISO}' || {NN} || '---' || {NN}
                   || CASE WHEN count(*) > 1 THEN '## Table of Contents' || {NN}
                        || string_agg(toc, {NL} ORDER BY k1, k2 NULLS FIRST, first_pos) || {NN} || '---' || {NN} ELSE '' END
                   || string_agg(block, '' ORDER BY k1, k2 NULLS FIRST, first_pos) AS content
          FROM pk JOIN (SELECT DISTINCT job_id, domain FROM v) d ON d.job_id = pk.job_id GROUP BY pk.job_id)
SELECT doc.job_id, d.domain, categories, regexp_replace(content, '\\n$', '') AS content
FROM doc JOIN (SELECT DISTINCT job_id, domain FROM v) d ON d.job_id = doc.job_id"""


_PATH_PAGES = f"""
, pg AS (SELECT job_id, url, {Q.category('url')} AS category,
                row_number() OVER (PARTITION BY job_id ORDER BY url, created_at, id) AS pos FROM v)"""


@register("full_documents", "I3,I4,I5,I6,I7", sql=_full_doc_sql(_PATH_PAGES))
def q_full_documents(spark, sf):
    return A.full_document(_details(spark, sf), AS_OF)


@register("category_page_counts", "D7,I3", sql=with_views("d_version_page") + f"""
SELECT job_id, {Q.category('url')} AS category, count(*) AS pages FROM d_version_page GROUP BY 1, 2""")
def q_category_counts(spark, sf):
    return A.category_counts(D.page_versions(spark, sf, with_page=True))


@register("page_rank", "I8", sql=f"""
WITH p AS (SELECT page_id, url, length(html) AS n, coalesce({Q.path('url')}, url) AS path FROM pages)
SELECT page_id, url, greatest(0, least(100, 50
  + CASE WHEN url = '/' OR ends_with(url, '/index') THEN 20 ELSE 0 END
  + CASE WHEN contains(url, '/docs') OR contains(url, '/documentation') THEN 15 ELSE 0 END
  + CASE WHEN contains(url, '/api') THEN 15 ELSE 0 END
  + CASE WHEN contains(url, '/guide') OR contains(url, '/getting-started') THEN 10 ELSE 0 END
  + CASE WHEN contains(url, '/features') THEN 10 ELSE 0 END
  - len(list_filter(string_split(path, '/'), lambda s: s <> '')) * 5
  - CASE WHEN contains(url, '/privacy') OR contains(url, '/terms') OR contains(url, '/legal') THEN 20 ELSE 0 END
  - CASE WHEN contains(url, '/404') OR contains(url, '/error') THEN 30 ELSE 0 END
  + CASE WHEN n > 5000 THEN 10 ELSE 0 END + CASE WHEN n > 10000 THEN 10 ELSE 0 END)) AS score,
  row_number() OVER (PARTITION BY {Q.host('url')} ORDER BY greatest(0, least(100, 50
  + CASE WHEN url = '/' OR ends_with(url, '/index') THEN 20 ELSE 0 END
  + CASE WHEN contains(url, '/docs') OR contains(url, '/documentation') THEN 15 ELSE 0 END
  + CASE WHEN contains(url, '/api') THEN 15 ELSE 0 END
  + CASE WHEN contains(url, '/guide') OR contains(url, '/getting-started') THEN 10 ELSE 0 END
  + CASE WHEN contains(url, '/features') THEN 10 ELSE 0 END
  - len(list_filter(string_split(path, '/'), lambda s: s <> '')) * 5
  - CASE WHEN contains(url, '/privacy') OR contains(url, '/terms') OR contains(url, '/legal') THEN 20 ELSE 0 END
  - CASE WHEN contains(url, '/404') OR contains(url, '/error') THEN 30 ELSE 0 END
  + CASE WHEN n > 5000 THEN 10 ELSE 0 END + CASE WHEN n > 10000 THEN 10 ELSE 0 END)) DESC, page_id) AS rank_in_site
FROM p""")
def q_page_rank(spark, sf):
    from ..operators.catalog import split_row_number
    p = D.crawled_pages(spark, sf)
    scored = p.select("page_id", "url", F.coalesce("domain", F.lit("")).alias("domain"),
                      A.page_rank_score(F.col("url"), F.length("raw_md")).cast("long").alias("score"))
    # a site's pages are numbered within each of its at most 101 scores
    ranked = split_row_number(scored.withColumn("low", -F.col("score")), "domain", "low", "page_id", bucket_col="low")
    return ranked.select("page_id", "url", "score", F.col("rn").alias("rank_in_site"))


# category responses per job, spelled by job id % 9: a valid object, an object
# with a non-array value, an integer-like category name, text that is not JSON,
# missing, empty, an array, null, and an object without categories.
CATEGORY_RESPONSES = [
    '{"Documentation": ["/docs"], "Blog": ["/blog"], "Company": ["/about", "/contact", "/pricing"]}',
    '{"Guides": ["/docs/guides", "/getting-started"], "Features": "/features", "Product": ["/features", "/pricing"]}',
    '{"Docs": ["/docs/"], "2024": ["/blog/"], "10": ["/api"]}',
    'Here are your categories: Documentation, Blog',
    None, "", '[["/docs", "/blog"], "/about", ["/pricing"]]', "null", '{"Empty": []}',
]


def _category_responses(spark, sf):
    j = D.jobs(spark, sf).select(F.col("id").alias("job_id"))
    resp = F.element_at(F.array(*[F.lit(r).cast("string") for r in CATEGORY_RESPONSES]),
                        (F.col("job_id") % len(CATEGORY_RESPONSES) + 1).cast("int"))
    return j.select("job_id", resp.alias("response"))


_RESP_SQL = "[" + ", ".join("NULL" if r is None else "'" + r.replace("'", "''") + "'" for r in CATEGORY_RESPONSES) + "]"
# parsed(job_id, js: NULL where the text is not JSON) and cats, by the rules of H7
_CATS_SQL = f"""
, r AS (SELECT id AS job_id, coalesce(nullif({_RESP_SQL}[CAST(id % {len(CATEGORY_RESPONSES)} + 1 AS INTEGER)], ''), '{{}}') AS response FROM d_job)
, parsed AS (SELECT job_id, TRY_CAST(response AS JSON) AS js FROM r)
, entry AS (SELECT job_id, unnest(json_keys(js)) AS category, generate_subscripts(json_keys(js), 1) - 1 AS cat_pos,
                   unnest(list_transform(json_keys(js), lambda k: js -> k)) AS val
            FROM parsed WHERE json_type(js) = 'OBJECT'
            UNION ALL
            SELECT job_id, CAST(i AS VARCHAR), i, js -> CAST(i AS INTEGER)
            FROM (SELECT job_id, js, unnest(range(CAST(json_array_length(js) AS BIGINT))) AS i FROM parsed WHERE json_type(js) = 'ARRAY'))
, cats AS (SELECT job_id, category, cat_pos, CAST(val AS VARCHAR[]) AS patterns FROM entry WHERE json_type(val) = 'ARRAY'
           UNION ALL SELECT job_id, 'Pages', 0, [''] FROM parsed WHERE js IS NULL OR json_type(js) = 'NULL')"""


@register("category_assignment", "H7,C6", sql=_V + _CATS_SQL + """
, pg AS (SELECT job_id, url, row_number() OVER (PARTITION BY job_id ORDER BY url, created_at, id) AS pos FROM v)
, hits AS (SELECT DISTINCT c.job_id, c.category, c.cat_pos, pg.url, pg.pos
           FROM cats c JOIN pg ON pg.job_id = c.job_id
           WHERE len(list_filter(c.patterns, lambda x: contains(pg.url, x))) > 0)
SELECT job_id, category, cat_pos, url, pos FROM hits""")
def q_category_assignment(spark, sf):
    pages = A.categorized_pages(_details(spark, sf)).select("job_id", "url", "pos")
    return A.match_categories(pages, A.parse_category_response(_category_responses(spark, sf)))


@register("uncategorized_pages", "C6", sql=_V + _CATS_SQL + """
, u AS (SELECT DISTINCT job_id, url FROM v)
SELECT u.job_id, count(*) AS pages, count(*) FILTER (WHERE NOT EXISTS (
         SELECT 1 FROM cats c WHERE c.job_id = u.job_id AND len(list_filter(c.patterns, lambda x: contains(u.url, x))) > 0)) AS uncategorized
FROM u GROUP BY u.job_id""")
def q_uncategorized(spark, sf):
    """Every job through the pattern index, whatever its size."""
    pages = _details(spark, sf).select("job_id", "url").distinct()
    return A.uncategorized_counts(pages, A.match_categories(pages, A.parse_category_response(_category_responses(spark, sf)), pair_limit=0))


def _categorized_sql() -> str:
    return _V + _CATS_SQL + f"""
, hits AS (SELECT DISTINCT c.job_id, c.category, c.cat_pos, v.url FROM cats c JOIN v ON v.job_id = c.job_id
           WHERE len(list_filter(c.patterns, lambda x: contains(v.url, x))) > 0)
, fs AS (SELECT job_id, url, count(*) OVER (PARTITION BY job_id, url) AS n_url, {_SECTION3} AS section FROM v
         QUALIFY row_number() OVER (PARTITION BY job_id, url ORDER BY created_at, id) = 1)
, pc AS (SELECT h.job_id, h.category, h.cat_pos, sum(fs.n_url) AS n,
                '## ' || h.category || {NN} || string_agg(repeat(fs.section, CAST(fs.n_url AS INTEGER)), '' ORDER BY fs.url) AS block
         FROM hits h JOIN fs ON fs.job_id = h.job_id AND fs.url = h.url GROUP BY h.job_id, h.category, h.cat_pos)
, emp AS (SELECT c.job_id, c.category, c.cat_pos, 0 AS n, '' AS block
          FROM (SELECT DISTINCT job_id, category, cat_pos FROM cats) c
          WHERE NOT EXISTS (SELECT 1 FROM pc WHERE pc.job_id = c.job_id AND pc.category = c.category)
            AND c.job_id IN (SELECT job_id FROM v))
, allc AS (SELECT * FROM pc UNION ALL SELECT * FROM emp)
, pk AS (SELECT *, NOT {_IS_INDEX} AS k1, CASE WHEN {_IS_INDEX} THEN TRY_CAST(category AS BIGINT) END AS k2,
                '- [' || category || '](#' || {_ANCHOR} || ') (' || CAST(n AS VARCHAR) || ' pages)' AS toc FROM allc)
, d AS (SELECT DISTINCT job_id, domain FROM v)
, doc AS (SELECT pk.job_id, count(*) AS categories,
                 '# ' || any_value(d.domain) || ' - Complete Documentation' || {NN} || '> Comprehensive content archive from '
                   || any_value(d.domain) || {NN} || 'Generated: {ISO}' || {NN} || '---' || {NN}
                   || CASE WHEN count(*) > 1 THEN '## Table of Contents' || {NN}
                        || string_agg(toc, {NL} ORDER BY k1, k2 NULLS FIRST, cat_pos) || {NN} || '---' || {NN} ELSE '' END
                   || string_agg(block, '' ORDER BY k1, k2 NULLS FIRST, cat_pos) AS content
          FROM pk JOIN d ON d.job_id = pk.job_id GROUP BY pk.job_id)
SELECT d.job_id, d.domain, coalesce(categories, 0) AS categories,
       regexp_replace(coalesce(content, '# ' || d.domain || ' - Complete Documentation' || {NN}
         || '> Comprehensive content archive from ' || d.domain || {NN} || 'Generated: {ISO}' || {NN} || '---' || {NN}),
         '\\n$', '') AS content
FROM d LEFT JOIN doc ON d.job_id = doc.job_id"""


@register("full_documents_categorized", "I4,I5,C6,H7", sql=_categorized_sql())
def q_full_documents_ai(spark, sf):
    """Full documents with response-driven categories (C6). Category order
    follows the response object's key order (index-like names first), empty
    categories appear in the contents only."""
    # sections come dealt by job and stay so to the end: what needs them whole reads them once
    n = D.tasks_by_job(spark, sf)
    per_url = A.url_sections(_details(spark, sf))
    parsed = stored(A.parse_category_response(_category_responses(spark, sf)), "categories")
    per_job = D.page_versions(spark, sf).groupBy("job_id").agg(F.count(F.lit(1)).alias("pages"))
    taken = A.match_categories(per_url, parsed, tasks=n, per_job=per_job)
    return A.full_document_of(taken, AS_OF)


def _artifact_sql() -> str:
    from .q_schedule import _DATE_SQL, _SAN
    gated = with_views("d_version_detail", "d_job", "d_domain", "d_version", "d_artifact") + """
, g AS (SELECT job_id FROM d_version GROUP BY job_id
        HAVING NOT ((bool_and(coalesce(change_status = 'same', false)) AND count(*) > 0)
                    OR count(*) FILTER (WHERE importance IS NULL OR importance >= 2) = 0))
, v AS (SELECT vd.job_id, vd.id, vd.url, vd.title, vd.description, vd.summary, vd.created_at, d.domain
        FROM d_version_detail vd JOIN d_job j ON j.id = vd.job_id JOIN d_domain d ON d.id = j.domain_id
        WHERE vd.job_id IN (SELECT job_id FROM g))"""
    body = _full_doc_sql(_PATH_PAGES)[len(_V):]
    body = body.replace("\nSELECT doc.job_id, d.domain, categories,",
                        "\n, fdoc AS (SELECT doc.job_id, d.domain, categories,") + ")"
    return gated + body + ", idoc AS (" + _INDEX_SELECT + ")" + f"""
, docs AS (SELECT job_id, domain, 'llms_txt' AS kind, content FROM idoc
           UNION ALL SELECT job_id, domain, 'llms_full_txt', content FROM fdoc)
, mx AS (SELECT domain_id, kind, max(version) AS mx FROM d_artifact GROUP BY domain_id, kind)
SELECT docs.job_id, j.domain_id, docs.kind,
       CAST(coalesce(mx.mx, 0) + row_number() OVER (PARTITION BY j.domain_id, docs.kind ORDER BY j.started_at, docs.job_id)
            AS INTEGER) AS version,
       'domains/' || {_SAN.format(u='docs.domain')} || '/jobs/' || {_DATE_SQL.format(t='j.started_at')} || '_'
         || CAST(docs.job_id AS VARCHAR) || '/' || CASE WHEN docs.kind = 'llms_txt' THEN 'llms.txt' ELSE 'llms-full.txt' END
         AS path,
       length(docs.content) AS content_chars
FROM docs JOIN d_job j ON j.id = docs.job_id LEFT JOIN mx ON mx.domain_id = j.domain_id AND mx.kind = docs.kind
WHERE docs.content IS NOT NULL"""


@register("artifact_rows", "I9,E8,J4,A6", sql=_artifact_sql())
def q_artifact_rows(spark, sf):
    """Both documents for jobs passing the gate, versioned after the existing
    artifacts of the same domain and kind."""
    versions = D.job_page_details(spark, sf).select(
        "job_id", "domain", "id", "url", "title", "description", "summary", "created_at", "importance", "change_status")
    gate = A.assembly_gate(versions).filter("should_generate").select("job_id")
    # dealt by job, so the gate, both documents and what they are made of stay in place
    det = versions.join(gate, "job_id", "left_semi")
    idx = A.index_document(det, AS_OF).select("job_id", "domain", F.lit("llms_txt").alias("kind"), "content")
    full = A.full_document(det, AS_OF).select("job_id", "domain", F.lit("llms_full_txt").alias("kind"), "content")
    return A.artifact_rows(idx.unionByName(full), D.jobs(spark, sf), D.artifacts(spark, sf))


@register("rendered_templates", "I10,C1", sql=with_views("d_domain", "d_profile", "d_version_detail") + """
, s AS (SELECT domain_id, string_agg('- ' || url || ': ' || summary, chr(10) ORDER BY url, id) AS summaries
        FROM d_version_detail WHERE summary <> '' GROUP BY domain_id)
, r AS (SELECT d.id AS domain_id, d.domain, p.template,
               replace(replace(p.header, '{{date}}', '2024-02-01'), '{{domain}}', d.domain) AS hdr
        FROM d_domain d JOIN d_profile p ON p.id = d.profile_id)
SELECT domain_id, replace(replace(replace(replace(replace(template, '{{header}}', coalesce(hdr, '')),
         '{{date}}', '2024-02-01'), '{{domain}}', domain),
         '{{domainSummary}}', 'Comprehensive content archive from ' || domain), '{{pageSummaries}}', coalesce(s.summaries, '')) AS rendered
FROM r LEFT JOIN s USING (domain_id)""")
def q_templates(spark, sf):
    d = D.domains(spark, sf).select(F.col("id").alias("domain_id"), "domain", "profile_id")
    p = D.profiles(spark, sf).select(F.col("id").alias("profile_id"), "template", "header")
    # a rendered template holds all page summaries of its domain
    line = F.concat(F.lit("- "), F.col("url"), F.lit(": "), F.col("summary"))
    s = (D.page_version_details(spark, sf).filter(F.col("summary") != "").groupBy("domain_id")
         .agg(F.array_sort(F.collect_list(F.struct("url", "id", line.alias("line")))).alias("_s"))
         .select("domain_id", F.array_join(F.transform("_s", lambda e: e["line"]), "\n").alias("summaries")))
    x = d.join(p, "profile_id").join(s, "domain_id", "left")
    date = F.lit(AS_OF[:10])
    hdr = F.replace(F.replace(F.col("header"), F.lit("{{date}}"), date), F.lit("{{domain}}"), F.col("domain"))
    return x.select("domain_id", A.render_template(
        F.col("template"), hdr, date, F.col("domain"),
        F.concat(F.lit("Comprehensive content archive from "), F.col("domain")),
        F.coalesce("summaries", F.lit(""))).alias("rendered"))


@register("carry_forward_documents", "I11,I2,E4", sql=with_views("d_version_detail", "d_job", "d_domain") + """
, lf AS (SELECT domain_id, id AS job_id, finished_at AS cut FROM d_job WHERE status = 'finished'
         QUALIFY row_number() OVER (PARTITION BY domain_id ORDER BY finished_at DESC NULLS FIRST, id DESC) = 1)
, acc AS (SELECT vd.* FROM d_version_detail vd JOIN lf ON lf.domain_id = vd.domain_id
          WHERE (vd.importance IS NULL OR vd.importance >= 2) AND vd.created_at <= lf.cut)
, lt AS (SELECT * FROM acc QUALIFY row_number() OVER (PARTITION BY domain_id, url ORDER BY created_at DESC, id DESC) = 1)
, v AS (SELECT lf.job_id, lt.id, lt.url, lt.title, lt.description, lt.summary, lt.created_at, d.domain
        FROM lt JOIN lf ON lf.domain_id = lt.domain_id JOIN d_domain d ON d.id = lt.domain_id)""" + _INDEX_SELECT)
def q_carry_forward(spark, sf):
    det = D.page_version_details(spark, sf)
    inputs = _with_domain(spark, sf, A.carry_forward_inputs(det, D.jobs(spark, sf)))
    return A.index_document(inputs.select("job_id", "domain", "id", "url", "title", "description", "summary",
                                          "created_at").repartition("job_id"), AS_OF)


# ---- request / response tables ----------------------------------------------------------

@register("summary_requests", "H1,H8", sql=f"""
SELECT doc_id,
       {_lit(H.SUMMARY_INTRO)}
         || CASE WHEN {_nz('source')} THEN 'Page title: ' || source ELSE '' END || {NL}
         || CASE WHEN {_nz('lang')} THEN 'Existing description: ' || lang ELSE '' END
         || {NL} || {NL} || 'Page content:' || {NL} || substr(text, 1, 8000) || ' '
         || CASE WHEN length(text) > 8000 THEN '...[truncated]' ELSE '' END
         || {_lit(H.SUMMARY_OUTRO)} AS request,
       CAST(ceil(length({_lit(H.SUMMARY_SYSTEM)}) / 4) AS BIGINT)
         + CAST(ceil(length({_lit(H.SUMMARY_INTRO)}
         || CASE WHEN {_nz('source')} THEN 'Page title: ' || source ELSE '' END || {NL}
         || CASE WHEN {_nz('lang')} THEN 'Existing description: ' || lang ELSE '' END
         || {NL} || {NL} || 'Page content:' || {NL} || substr(text, 1, 8000) || ' '
         || CASE WHEN length(text) > 8000 THEN '...[truncated]' ELSE '' END
         || {_lit(H.SUMMARY_OUTRO)}) / 4) AS BIGINT) AS prompt_tokens
FROM documents""")
def q_summary_requests(spark, sf):
    d = read_table(spark, sf, "documents")
    req = H.page_summary_request(F.col("text"), F.col("source"), F.col("lang"))
    return d.select("doc_id", req.alias("request"),
                    H.token_estimate(F.lit(H.SUMMARY_SYSTEM), req).alias("prompt_tokens"))


# summary responses per document, spelled by doc_id % 5 (fixed values)
def _summary_responses(spark, sf):
    d = read_table(spark, sf, "documents")
    k = F.col("doc_id") % 5
    first = F.split(F.col("text"), "\n", -1).getItem(0)
    resp = (F.when(k == 0, F.to_json(F.struct(first.alias("description"), F.col("text").alias("summary"))))
            .when(k == 1, F.lit('{"description": ""}'))
            .when(k == 2, F.lit("not json"))
            .when(k == 3, F.lit(None).cast("string"))
            .otherwise(F.lit('{"summary": "short"}')))
    return d.select("doc_id", resp.alias("response"))


@register("summary_responses", "H2", sql=f"""
WITH r AS (SELECT doc_id, CASE doc_id % 5
             WHEN 0 THEN json_object('description', string_split(text, {NL})[1], 'summary', text)::VARCHAR
             WHEN 1 THEN '{{"description": ""}}' WHEN 2 THEN 'not json' WHEN 3 THEN NULL
             ELSE '{{"summary": "short"}}' END AS response FROM documents)
, p AS (SELECT doc_id, TRY_CAST(response AS JSON) AS js FROM r)
SELECT doc_id,
       substr(CASE WHEN {_nz("json_extract_string(js, '$.description')")} THEN json_extract_string(js, '$.description')
                   ELSE 'Page content' END, 1, 100) AS description,
       substr(CASE WHEN {_nz("json_extract_string(js, '$.summary')")} THEN json_extract_string(js, '$.summary')
                   ELSE '' END, 1, 500) AS summary
FROM p""")
def q_summary_responses(spark, sf):
    r = _summary_responses(spark, sf)
    desc, summ = H.parse_summary_response(F.col("response"))
    return r.select("doc_id", desc.alias("description"), summ.alias("summary"))


@register("enhancement_requests", "H4,C1,G7", sql=with_views("d_version_detail", "d_domain", "d_profile") + f"""
SELECT v.id, d.model, coalesce(p.summary_prompt, {_lit(H.ENHANCE_SYSTEM)}) AS system_prompt,
       'Process the following markdown content:' || {NN} || coalesce(pg.html, v.summary, v.title) AS user_message
FROM d_version_detail v JOIN d_domain d ON d.id = v.domain_id LEFT JOIN d_profile p ON p.id = d.profile_id
LEFT JOIN pages pg ON pg.page_id = v.page_id
WHERE v.importance >= 2""")
def q_enhancement_requests(spark, sf):
    return _enhancement_inputs(spark, sf).select("id", "model", F.col("system").alias("system_prompt"), F.col("user").alias("user_message"))


def _enhancement_inputs(spark, sf):
    """H4 for every version to enhance: the stored page text where there is one,
    else the version's summary or title."""
    v = D.page_version_details(spark, sf).filter(F.col("importance") >= 2)
    d = D.domains(spark, sf).select(F.col("id").alias("domain_id"), "model", "profile_id")
    p = D.profiles(spark, sf).select(F.col("id").alias("profile_id"), "summary_prompt")
    text = D.crawled_pages(spark, sf).select("page_id", "raw_md")
    x = v.join(d, "domain_id").join(p, "profile_id", "left").join(text, "page_id", "left")
    system, user = H.enhancement_request(F.coalesce("raw_md", "summary", "title"), F.col("summary_prompt"))
    return x.select("id", "job_id", "model", system.alias("system"), user.alias("user"))


@register("site_requests", "H5,H6,E11", sql=_V + f"""
, u AS (SELECT DISTINCT job_id, url FROM v)
, f AS (SELECT job_id, count(*) AS n,
               string_agg(CASE WHEN rn <= 10 THEN '- ' || url END, {NL} ORDER BY rn) AS first_urls
        FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY url) AS rn FROM u) GROUP BY job_id)
, c AS (SELECT job_id, any_value(domain) AS domain,
               string_agg('- ' || url || ' (' || {_title_sql('Page')} || ')', {NL} ORDER BY url, created_at, id) AS page_lines,
               string_agg({NL} || '- Title: ' || {_title_sql('Page')} || {NL} || '  URL: ' || url || {NL}
                          || '  Description: ' || CASE WHEN {_nz('v.description')} THEN v.description ELSE 'Page content' END
                          || {NL} || '  ' || CASE WHEN {_nz('v.summary')} THEN 'Summary: ' || v.summary ELSE '' END,
                          {NL} ORDER BY url, created_at, id) AS ctx
        FROM v GROUP BY job_id)
SELECT c.job_id,
       'Create a comprehensive overview for ' || c.domain || '.' || {NL} || 'The site has ' || CAST(f.n AS VARCHAR)
         || ' pages. Here are some key URLs to understand the site structure:' || {NL} || f.first_urls
         || {_lit(H.OVERVIEW_OUTRO)} AS overview_request,
       'Categorize these pages into logical groups:' || {NL} || c.page_lines
         || {_lit(H.CATEGORY_OUTRO)} AS category_request,
       length(c.ctx) AS context_chars
FROM c JOIN f ON f.job_id = c.job_id""")
def q_site_requests(spark, sf):
    from ..operators.catalog import first_pages
    det = _details(spark, sf)
    fp = first_pages(det, 10)
    t = A.display_title(F.col("title"), F.col("url"), "Page")
    desc = F.when(F.col("description").isNotNull() & (F.col("description") != ""), F.col("description")) \
        .otherwise(F.lit("Page content"))
    per = det.groupBy("job_id", "domain").agg(F.array_sort(F.collect_list(F.struct(
        "url", "created_at", "id", F.concat(F.lit("- "), F.col("url"), F.lit(" ("), t, F.lit(")")).alias("line"),
        H.site_page_context(t, F.col("url"), desc, F.col("summary")).alias("ctx")))).alias("_p"))
    per = per.select("job_id", "domain", F.array_join(F.transform("_p", lambda x: x["line"]), "\n").alias("page_lines"),
                     F.array_join(F.transform("_p", lambda x: x["ctx"]), "\n").alias("ctx"))
    x = per.join(fp, "job_id")
    return x.select("job_id",
                    H.overview_request(F.col("domain"), F.col("page_count"), F.col("first_urls")).alias("overview_request"),
                    H.category_request(F.col("page_lines")).alias("category_request"),
                    F.length("ctx").cast("long").alias("context_chars"))


@register("site_document_requests", "H6", sql=_V + f"""
SELECT job_id, {H.site_document_sql("any_value(domain)", "'An overview of ' || any_value(domain)", f"""
       string_agg({NL} || '- Title: ' || {_title_sql('Page')} || {NL} || '  URL: ' || url || {NL}
                  || '  Description: ' || CASE WHEN {_nz('v.description')} THEN v.description ELSE 'Page content' END
                  || {NL} || '  ' || CASE WHEN {_nz('v.summary')} THEN 'Summary: ' || v.summary ELSE '' END,
                  {NL} ORDER BY url, created_at, id)""", _lit)} AS request
FROM v GROUP BY job_id""")
def q_site_document_requests(spark, sf):
    """The whole request text of H6 for every job, with a fixed overview."""
    det = _details(spark, sf)
    t = A.display_title(F.col("title"), F.col("url"), "Page")
    desc = F.when(F.col("description").isNotNull() & (F.col("description") != ""), F.col("description")) \
        .otherwise(F.lit("Page content"))
    per = det.groupBy("job_id", "domain").agg(F.array_sort(F.collect_list(F.struct(
        "url", "created_at", "id", H.site_page_context(t, F.col("url"), desc, F.col("summary")).alias("ctx")))).alias("_p"))
    ctx = F.array_join(F.transform("_p", lambda x: x["ctx"]), "\n")
    return per.select("job_id", H.site_document_request(
        F.col("domain"), F.concat(F.lit("An overview of "), F.col("domain")), ctx).alias("request"))


@register("job_token_totals", "H8,H4", sql=with_views("d_version_detail", "d_domain", "d_profile") + f"""
SELECT v.job_id, count(*) AS requests,
       CAST(sum(CAST(ceil(length(coalesce(p.summary_prompt, {_lit(H.ENHANCE_SYSTEM)})) / 4) AS BIGINT)
         + CAST(ceil(length('Process the following markdown content:' || {NN} || coalesce(pg.html, v.summary, v.title)) / 4) AS BIGINT))
         AS BIGINT) AS prompt_tokens
FROM d_version_detail v JOIN d_domain d ON d.id = v.domain_id LEFT JOIN d_profile p ON p.id = d.profile_id
LEFT JOIN pages pg ON pg.page_id = v.page_id
WHERE v.importance >= 2 GROUP BY v.job_id""")
def q_job_tokens(spark, sf):
    """H8 totals per job over its enhancement requests."""
    x = _enhancement_inputs(spark, sf)
    return x.groupBy("job_id").agg(F.count(F.lit(1)).alias("requests"),
                                   F.sum(H.token_estimate(F.col("system"), F.col("user"))).alias("prompt_tokens"))


@register("short_summary_requests", "H9", sql=f"""
SELECT page_id, 'Summarize this page from ' || url || ' in 200 characters or less:' || {NN}
         || substr({Q.clean_basic('html')}, 1, 3000)
         || {_lit(H.SHORT_SUMMARY_OUTRO)} AS request
FROM pages""")
def q_short_summary(spark, sf):
    from .q_text import _basic_clean
    p = D.crawled_pages(spark, sf)
    return p.select("page_id", H.short_summary_request(F.col("url"), _basic_clean(F.col("raw_md"))).alias("request"))


@register("change_score_requests", "H3,H8,G4", sql=diff_text_sql(f"""
, m AS (SELECT id, page_id, 'Evaluate these changes:' || {NN} || diff_text AS request FROM dt)
SELECT id, page_id, request, CAST(ceil(length({_lit(H.SCORE_SYSTEM)}) / 4) + ceil(length(request) / 4) AS BIGINT) AS prompt_tokens FROM m"""))
def q_score_requests(spark, sf):
    """Scorer requests for changed versions only (diff text from G4), with
    token estimates; first versions and unchanged pairs need no request."""
    from ..operators.versions import process_versions
    v = process_versions(D.version_chain(spark, sf), with_diff_text=True).filter(F.col("has_changes"))
    req = H.change_score_request(F.col("diff_text"))
    return v.select("id", "page_id", req.alias("request"),
                    H.token_estimate(F.lit(H.SCORE_SYSTEM), req).alias("prompt_tokens"))
