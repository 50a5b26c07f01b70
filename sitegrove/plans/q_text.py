"""Registered text queries: cleaning (F), title, enhancement, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import text_ops
from ..sources import derived as D
from ..sources.tables import read_table
from . import sqlfrag as Q
from .registry import register
from .sqlviews import with_views


def _basic_clean(col):
    s = col
    for step in (T.strip_comments, T.strip_scripts, T.strip_styles, T.drop_consent_lines,
                 T.collapse_blank_runs, T.drop_empty_images, T.drop_cta_lines, T.clamp_markup_runs):
        s = step(s)
    return s


# --- minimum slice: pages -> clean -> title -> host -> category -> counts ---------------

@register("pages_by_host_category", "F1-F3,F5-F9,F14,J2,I3,D7", sql=with_views("d_page") + f"""
, c AS (SELECT domain, {Q.category('url')} AS category, {Q.clean_basic('raw_md')} AS md FROM d_page)
SELECT domain, category, count(*) AS pages, CAST(sum(length(md)) AS BIGINT) AS chars,
       min({Q.title('md')}) AS first_title
FROM c GROUP BY domain, category""")
def pages_by_host_category(spark, sf_dir):
    p = D.crawled_pages(spark, sf_dir)
    c = p.select("domain", S.path_category(F.col("url")).alias("category"),
                 _basic_clean(F.col("raw_md")).alias("md"))
    return (c.groupBy("domain", "category")
            .agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("md")).cast("long").alias("chars"),
                 F.min(T.extract_title(F.col("md"))).alias("first_title")))


@register("clean_pages_basic", "F1,F2,F3,F5,F6,F7,F8,F9", sql=with_views("d_page") + f"""
SELECT page_id, {Q.clean_basic('raw_md')} AS cleaned_md FROM d_page""")
def clean_pages_basic(spark, sf_dir):
    p = D.crawled_pages(spark, sf_dir)
    return p.select("page_id", _basic_clean(F.col("raw_md")).alias("cleaned_md"))


def _sql_dedupe(src: str, key: str, text: str, p: str = "") -> str:
    """F10 as set SQL: lines with position, first per heading key, re-joined
    (CTEs named with prefix ``p``; result ``{p}dd(k_id, md)``)."""
    return f"""
, {p}l AS (SELECT {key} AS k_id, generate_subscripts(string_split({text}, chr(10)), 1) AS pos,
               unnest(string_split({text}, chr(10))) AS line FROM {src})
, {p}r AS (SELECT k_id, pos, line,
               CASE WHEN starts_with(line, '#') THEN row_number() OVER (
                   PARTITION BY k_id, CASE WHEN starts_with(line, '#') THEN lower({Q.js_trim('line')}) END
                   ORDER BY pos) ELSE 1 END AS rn FROM {p}l)
, {p}dd AS (SELECT k_id, string_agg(line, chr(10) ORDER BY pos) AS md FROM {p}r WHERE rn = 1 GROUP BY k_id)"""


def _sql_clean(src: str, key: str, text: str, p: str) -> str:
    """F11 as SQL CTEs over ``src``: result ``{p}clean(k_id, text)``."""
    return (f", {p}pre AS (SELECT {key} AS k_id, {Q.clean_post(Q.boilerplate(Q.clean_pre(text)))} AS text FROM {src})"
            + _sql_dedupe(f"{p}pre", "k_id", "text", p)
            + f"\n, {p}clean AS (SELECT {p}pre.k_id, coalesce({Q.js_trim(p + 'dd.md')}, '') AS text "
              f"FROM {p}pre LEFT JOIN {p}dd ON {p}dd.k_id = {p}pre.k_id)")


def _sql_main(src: str, p: str) -> str:
    """F12 as SQL CTEs over ``src(k_id, text)`` (fallback: F11 of the input):
    result ``{p}main(k_id, main_lines, main_fallback, main_md)``."""
    return _sql_clean(src, "k_id", "text", p + "f") + f"""
, {p}ml AS (SELECT k_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
                unnest(string_split(text, chr(10))) AS line FROM {src})
, {p}mf AS (SELECT k_id, pos, line,
                regexp_matches(line, {Q.pattern(T.MAIN_HEADING_RE)}) AS is_main,
                regexp_matches(line, {Q.pattern(T.SKIP_HEADING_RE)}) AS is_skip,
                length({Q.js_trim('line')}) AS n FROM {p}ml)
, {p}mg AS (SELECT *, sum(CASE WHEN is_main THEN 1 ELSE 0 END) OVER w AS epoch,
                coalesce(last_value(CASE WHEN is_main THEN 1 WHEN is_skip THEN 0 END IGNORE NULLS) OVER w, 0) = 1 AS in_main
         FROM {p}mf WINDOW w AS (PARTITION BY k_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
, {p}mh AS (SELECT *, CASE WHEN NOT is_skip AND ((in_main AND n > 50) OR (NOT in_main AND n > 100)) THEN 1 ELSE 0 END AS inc
         FROM {p}mg)
, {p}mk AS (SELECT *, coalesce(max(inc) OVER (PARTITION BY k_id, epoch ORDER BY pos
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS depth_pos FROM {p}mh)
, {p}me AS (SELECT k_id, pos, line,
                CASE WHEN is_skip THEN 0 ELSE (CASE WHEN in_main OR depth_pos THEN 1 ELSE 0 END)
                     + (CASE WHEN NOT in_main AND n > 100 THEN 1 ELSE 0 END) END AS c FROM {p}mk)
, {p}mm AS (SELECT k_id, sum(c) AS kept,
                string_agg(CASE WHEN c = 2 THEN line || chr(10) || line ELSE line END, chr(10) ORDER BY pos)
                  FILTER (WHERE c > 0) AS md FROM {p}me GROUP BY k_id)
, {p}main AS (SELECT s.k_id, CAST(coalesce(mm.kept, 0) AS INTEGER) AS main_lines,
                     coalesce(mm.kept, 0) < 10 AS main_fallback,
                     CASE WHEN coalesce(mm.kept, 0) < 10 THEN fc.text ELSE mm.md END AS main_md
              FROM {src} s LEFT JOIN {p}mm mm ON mm.k_id = s.k_id LEFT JOIN {p}fclean fc ON fc.k_id = s.k_id)"""


@register("dedupe_headings_documents", "F10", sql="WITH src AS (SELECT doc_id, text FROM documents)" + _sql_dedupe("src", "doc_id", "text") + """
SELECT k_id AS doc_id, md AS deduped_md, length(md) AS n_chars FROM dd""")
def dedupe_headings_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    md = T.dedupe_headings(F.col("text"))
    return d.select("doc_id", md.alias("deduped_md"), F.length(md).cast("long").alias("n_chars"))


@register("clean_documents", "F4,F10,F11", sql="WITH src AS (SELECT doc_id, "
          + Q.clean_post(Q.boilerplate(Q.clean_pre("text"))) + " AS text FROM documents)"
          + _sql_dedupe("src", "doc_id", "text") + f"""
SELECT k_id AS doc_id, {Q.js_trim('md')} AS cleaned_md FROM dd""")
def clean_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", T.clean_markdown(F.col("text")).alias("cleaned_md"))


@register("title_documents", "F14,J10,J11", sql=f"""
SELECT doc_id, {Q.title('text')} AS title,
       list_aggregate(list_transform(string_split(source || '-' || lang, '-'),
           lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', ' ') AS source_label,
       CASE WHEN lang = 'en' THEN '/' WHEN lang = 'de' THEN '/docs/' || source
            WHEN lang = 'fr' THEN '/blog/' || source ELSE '/' || lang END AS path,
       CASE WHEN (CASE WHEN lang = 'en' THEN '/' WHEN lang = 'de' THEN '/docs/' || source
            WHEN lang = 'fr' THEN '/blog/' || source ELSE '/' || lang END) = '/' THEN 'homepage'
            WHEN contains(CASE WHEN lang = 'en' THEN '/' WHEN lang = 'de' THEN '/docs/' || source
            WHEN lang = 'fr' THEN '/blog/' || source ELSE '/' || lang END, '/docs') THEN 'documentation'
            WHEN contains(CASE WHEN lang = 'en' THEN '/' WHEN lang = 'de' THEN '/docs/' || source
            WHEN lang = 'fr' THEN '/blog/' || source ELSE '/' || lang END, '/blog') THEN 'blog'
            ELSE 'product' END AS page_type
FROM documents""")
def title_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    path = (F.when(F.col("lang") == "en", F.lit("/"))
            .when(F.col("lang") == "de", F.concat(F.lit("/docs/"), F.col("source")))
            .when(F.col("lang") == "fr", F.concat(F.lit("/blog/"), F.col("source")))
            .otherwise(F.concat(F.lit("/"), F.col("lang"))))
    return d.select("doc_id", T.extract_title(F.col("text")).alias("title"),
                    S.title_case_slug(F.concat_ws("-", "source", "lang")).alias("source_label"),
                    path.alias("path"), S.path_page_type(path).alias("page_type"))


def _meta(e: str) -> str:
    for pat in T.METADATA_RES:
        e = Q.rx(e, pat)
    return e


@register("strip_metadata_documents", "F13", sql=f"""
SELECT doc_id, {_meta('text')} AS md, length({_meta('text')}) AS n_chars FROM documents""")
def strip_metadata_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    md = T.drop_metadata_lines(F.col("text"))
    return d.select("doc_id", md.alias("md"), F.length(md).cast("long").alias("n_chars"))


def _enhance_sql(e: str) -> str:
    """F16 as SQL."""
    keep = " AND ".join([f"length({Q.js_trim('l')}) > 0"] + [f"NOT contains(l, '{p}')" for p in T.ENHANCE_DROP_PHRASES])
    return ("('# [Processed Document]' || chr(10) || chr(10) || array_to_string(list_filter(string_split("
            + e + ", chr(10)), lambda l: " + keep + "), chr(10)) || chr(10) || chr(10) || '---' || chr(10) || "
            "'_Content processed and optimized for LLM consumption_')")


@register("enhance_documents", "F16,F17", sql=f"""
SELECT doc_id, {_enhance_sql("text")} AS enhanced_md,
       substr(CASE WHEN string_split(text, chr(10))[1] <> '' THEN string_split(text, chr(10))[1]
                   ELSE 'Page content' END, 1, 100) AS description,
       CASE WHEN length(text) > 500 THEN substr(text, 1, 500) ELSE '' END AS summary
FROM documents""")
def enhance_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    t = F.col("text")
    return d.select("doc_id", T.enhance_content(t).alias("enhanced_md"),
                    T.deterministic_description(t).alias("description"),
                    T.deterministic_summary(t).alias("summary"))


_FP_SQL = Q.js_trim(Q.rx("lower(text)", r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+", "' '"))
_DN_SQL = Q.js_trim(f"replace(replace(text, chr(13) || chr(10), chr(10)), chr(9), '  ')")


@register("fingerprint_documents", "G1,G9", sql=f"""
SELECT doc_id, sha256({_FP_SQL}) AS fingerprint, length({_DN_SQL}) AS normalized_chars FROM documents""")
def fingerprint_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"),
                    F.length(T.diff_normalize(F.col("text"))).cast("long").alias("normalized_chars"))


_MAIN_SQL = ("WITH src AS (SELECT doc_id AS k_id, text FROM documents)" + _sql_main("src", "x") + """
SELECT k_id AS doc_id, main_lines, main_fallback, main_md FROM xmain""")


@register("main_content_documents", "F12,F11", sql=_MAIN_SQL)
def main_content_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return text_ops.extract_main_content(d, "text", "main_md", key="doc_id").select(
        "doc_id", "main_md", "main_lines", "main_fallback")


_F15_SQL = ("WITH src AS (SELECT page_id, url, html FROM pages)" + _sql_clean("src", "page_id", "html", "a")
            + ", c1 AS (SELECT k_id, text FROM aclean)" + _sql_main("c1", "b") + f"""
SELECT s.page_id, s.url, {_meta('m.main_md')} AS cleaned_md FROM src s JOIN bmain m ON m.k_id = s.page_id""")


@register("clean_pipeline_pages", "F15,F11,F12,F13", sql=_F15_SQL)
def clean_pipeline_pages(spark, sf_dir):
    p = D.crawled_pages(spark, sf_dir)
    return text_ops.clean_pipeline(p, "raw_md", "cleaned_md", extract_main=True).select(
        "page_id", "url", "cleaned_md")
