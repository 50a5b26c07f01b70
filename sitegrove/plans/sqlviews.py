"""The derivation rules of ``sitegrove.sources.derived`` as DuckDB SQL.

The oracle SQL of every registered query starts with ``with_views(...)`` so
that the check runs the same rules on the same parquet files, independently of
the Spark code.
"""

from __future__ import annotations

from ..sources.derived import SITE_PATHS

_PATHS = "[" + ", ".join("'" + p.rstrip("/") + "'" for p in SITE_PATHS) + "]"

VIEWS = {
    "d_domain": """
SELECT c_custkey AS id,
       'site' || CAST(c_custkey AS VARCHAR) || '.example.com' AS domain,
       CAST(60 * (1 + c_custkey % 48) AS INTEGER) AS check_interval_minutes,
       'model-' || lower(c_mktsegment) AS model,
       CASE WHEN c_nationkey % 4 = 3 THEN NULL ELSE c_nationkey END AS profile_id,
       c_acctbal >= 0 AS is_active,
       TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at,
       TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(c_custkey % 365 AS INTEGER)) + to_days(c_nationkey) AS updated_at
FROM customer""",
    "d_job": """
SELECT o_orderkey AS id, o_custkey AS domain_id,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'initial' ELSE 'update' END AS type,
       CASE WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus = 'O' THEN 'processing'
            WHEN o_orderstatus = 'P' THEN 'failed' END AS status,
       'crawl-' || CAST(o_orderkey AS VARCHAR) AS external_id,
       o_orderdate AS started_at,
       CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_minutes(CAST(o_orderkey % 600 AS INTEGER)) END AS finished_at
FROM orders""",
    "d_version": """
SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS page_id, l_orderkey AS job_id,
       CASE WHEN l_returnflag = 'N' THEN 'same' WHEN l_returnflag = 'R' THEN 'changed' ELSE 'new' END AS change_status,
       CAST(CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_linenumber % 5 END AS SMALLINT) AS importance,
       l_shipdate AS created_at
FROM lineitem""",
    "d_version_page": f"""
SELECT v.*, o.o_custkey AS domain_id,
       'https://site' || CAST(o.o_custkey AS VARCHAR) || '.example.com'
         || {_PATHS}[CAST(v.page_id % 12 + 1 AS INTEGER)] || '/' || CAST(v.page_id AS VARCHAR) AS url
FROM d_version v JOIN orders o ON v.job_id = o.o_orderkey""",
    "d_version_detail": """
SELECT v.id, v.page_id, v.job_id, v.domain_id, v.url, v.change_status, v.importance, v.created_at,
       CASE WHEN (v.id % 8) % 4 = 0 THEN '' ELSE p.p_name END AS title,
       CASE WHEN (v.id % 8) % 3 = 0 THEN NULL ELSE p.p_type END AS description,
       CASE WHEN (v.id % 8) % 2 = 0 THEN p.p_name || ' by ' || p.p_brand END AS summary
FROM d_version_page v JOIN part p ON v.page_id = p.p_partkey""",
    "d_artifact": """
SELECT id * 2 + CASE WHEN kind = 'llms_txt' THEN 0 ELSE 1 END AS id,
       id AS job_id, domain_id, kind,
       CAST(row_number() OVER (PARTITION BY domain_id, kind ORDER BY started_at, id) AS INTEGER) AS version,
       CASE WHEN kind = 'llms_txt' THEN finished_at ELSE finished_at + INTERVAL 1 SECOND END AS created_at
FROM (SELECT j.*, k.kind FROM d_job j CROSS JOIN (VALUES ('llms_txt'), ('llms_full_txt')) k(kind)
      WHERE j.status = 'finished')""",
    "d_profile": """
SELECT n_nationkey AS id, n_name AS name,
       CASE WHEN n_nationkey % 2 = 0 THEN 'Summarize pages for readers in ' || n_name END AS summary_prompt,
       '# ' || n_name AS header,
       '{{header}}' || chr(10) || chr(10) || 'Date: {{date}}' || chr(10) || 'Domain: {{domain}}' || chr(10) || chr(10)
         || '{{domainSummary}}' || chr(10) || chr(10) || '{{pageSummaries}}' AS template,
       CASE WHEN n_nationkey % 5 = 0 THEN '{"similarityThreshold": 0.85}' ELSE '{}' END AS params,
       CAST(1 + n_nationkey % 3 AS INTEGER) AS version,
       TIMESTAMP '2023-01-01 00:00:00' + to_days(n_regionkey) AS created_at
FROM nation""",
    "d_chain": """
SELECT (conv_id + turn) * (conv_id + turn + 1) // 2 + turn AS id, conv_id AS page_id, turn AS seq, text FROM conversations""",
    "d_rechain": """
SELECT ((conv_id + turn) * (conv_id + turn + 1) // 2 + turn) * 3 + k AS id, conv_id AS page_id, turn * 3 + k AS seq, text
FROM conversations, unnest([0, 1, 2]) AS u(k)""",
    "d_rescore": """
SELECT ((conv_id + turn) * (conv_id + turn + 1) // 2 + turn) * 3 + k AS id,
       [' 3 ', '4', '1', '2 (moderate)', 'high', '9', NULL][CAST((conv_id + turn * 3 + k) % 7 + 1 AS INTEGER)] AS response
FROM conversations, unnest([0, 1, 2]) AS u(k)""",
    "d_score": """
SELECT (conv_id + turn) * (conv_id + turn + 1) // 2 + turn AS id,
       [' 3 ', '4', '1', '2 (moderate)', 'high', '9', NULL][CAST((conv_id + turn) % 7 + 1 AS INTEGER)] AS response
FROM conversations WHERE turn > 0""",
    "d_page": r"""
SELECT page_id, url,
       CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?([^/?#:]*)', 1) <> ''
            THEN lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?([^/?#:]*)', 1)) END AS domain,
       html AS raw_md
FROM pages""",
    "d_event": """
SELECT event_id, user_id AS job_id, 'crawl-' || CAST(user_id AS VARCHAR) AS external_id,
       CASE event_type WHEN 'signup' THEN 'crawl.started' WHEN 'view' THEN 'crawl.page'
            WHEN 'click' THEN 'crawl.page' WHEN 'purchase' THEN 'crawl.completed'
            WHEN 'error' THEN 'crawl.failed' END AS type,
       ts, value,
       CASE WHEN event_type IN ('view', 'click') THEN 'https://site' || CAST(user_id AS VARCHAR)
            || '.example.com/docs/' || json_extract_string(props, '$.k') END AS url,
       CASE WHEN event_type IN ('view', 'click') THEN CAST(user_id AS VARCHAR) || '-'
            || json_extract_string(props, '$.k') END AS scrape_id
FROM events""",
    "d_request": """
SELECT o_orderkey AS request_id,
       CASE WHEN o_orderkey % 4 = 0 THEN 'https://www.site' || CAST(o_custkey AS VARCHAR) || '.example.com/'
            WHEN o_orderkey % 4 = 1 THEN 'http://site' || CAST(o_custkey AS VARCHAR) || '.example.com/docs'
            WHEN o_orderkey % 4 = 2 THEN 'site' || CAST(o_custkey AS VARCHAR) || '.example.com'
            ELSE 'https://localhost/' END AS url,
       o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS requested_at
FROM orders
UNION ALL
SELECT -(page_id + 1) AS request_id, url,
       TIMESTAMP '2024-01-15 00:00:00' + to_minutes(CAST(page_id AS INTEGER)) AS requested_at
FROM pages""",
}

# views a view depends on (so only the needed ones are emitted, in order)
_DEPS = {"d_version_page": ["d_version"], "d_version_detail": ["d_version_page"],
         "d_artifact": ["d_job"]}


def with_views(*names: str) -> str:
    order: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n"
