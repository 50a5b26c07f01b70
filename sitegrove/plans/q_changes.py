"""Registered change-detection queries over the version chain (C7, G, D8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import changes as G
from ..operators.stored import stored_versions
from ..operators.versions import process_versions
from ..sources import derived as D
from . import sqlfrag as Q
from .registry import register
from .sqlviews import with_views


def _versions(spark, sf, with_text=False):
    return process_versions(D.version_chain(spark, sf), scores=D.scorer_responses(spark, sf),
                            with_diff_text=with_text)


def _lcs_sql(ta: str, tb: str) -> str:
    """Length of the longest common subsequence of two token lists, as a
    DuckDB row-by-row dynamic programme (list_reduce over the old tokens;
    each new row is the running max of the previous row and the matches)."""
    m = f"len({tb})"
    row = (f"[0] || list_transform([list_transform(range(1, {m} + 1), lambda k: CASE WHEN {tb}[k] = x "
           f"THEN prev[k] + 1 ELSE 0 END)], lambda c: list_transform(range(1, {m} + 1), "
           f"lambda j: greatest(prev[j + 1], list_max(c[1:j]))))[1]")
    return f"list_reduce({ta}, lambda prev, x: {row}, list_transform(range(0, {m} + 1), lambda z: 0))[-1]"


def _tokens_sql(e: str) -> str:
    parts = f"string_split({e}, chr(10))"
    return (f"(CASE WHEN {e} = '' THEN []::VARCHAR[] ELSE list_transform({parts}, lambda l, i: "
            f"CASE WHEN i < len({parts}) THEN l || chr(10) ELSE l END) END)")


def _nl_sql(e: str) -> str:
    return f"(length({e}) - length(replace({e}, chr(10), '')))"


def _diff_text_sql(ta: str, tb: str) -> str:
    """The diff text of two token lists by the table of suffix lengths, filled from
    the end, a walk that takes each old token in turn if a longest common
    subsequence can hold it (at its next place), and the hunks in order."""
    row = (f"list_transform([list_transform(range(1, len({tb}) + 1), lambda k: CASE WHEN {tb}[k] = x THEN rows[1][k + 1] + 1 ELSE 0 END) || [0]], "
           f"lambda c: list_transform(range(1, len({tb}) + 2), lambda j: greatest(rows[1][j], list_max(c[j:]))))[1]")
    table = f"list_reduce(list_reverse({ta}), lambda rows, x: list_prepend({row}, rows), [list_transform(range(0, len({tb}) + 1), lambda z: 0::BIGINT)])"
    place = f"(s.j - 1 + list_position({tb}[s.j:], {ta}[i]))"
    walk = (f"list_reduce(range(1, len({ta}) + 1), lambda s, i: CASE WHEN list_contains({tb}[s.j:], {ta}[i]) AND t[i + 1][{place} + 1] + 1 = t[i][s.j] "
            f"THEN {{'j': {place} + 1, 'p': list_append(s.p, {{'i': i, 'j': {place}}})}} ELSE s END, {{'j': 1::BIGINT, 'p': []::STRUCT(i BIGINT, j BIGINT)[]}}).p")
    pairs = f"list_transform([{table}], lambda t: {walk})[1]"
    ends = f"list_append({pairs}, {{'i': len({ta}) + 1, 'j': len({tb}) + 1}})"
    same = "CASE WHEN h.same <> '' THEN '  ' || h.same ELSE '' END"
    hunks = (f"list_reduce({ends}, lambda h, q: {{'o': CASE WHEN q.i > h.i OR q.j > h.j THEN h.o || {same} "
             f"|| CASE WHEN q.i > h.i THEN '- ' || array_to_string({ta}[h.i:q.i - 1], '') ELSE '' END "
             f"|| CASE WHEN q.j > h.j THEN '+ ' || array_to_string({tb}[h.j:q.j - 1], '') ELSE '' END ELSE h.o END, "
             f"'same': CASE WHEN q.i > h.i OR q.j > h.j THEN '' ELSE h.same END || coalesce({ta}[q.i], ''), 'i': q.i + 1, 'j': q.j + 1}}, "
             "{'o': '', 'same': '', 'i': 1::BIGINT, 'j': 1::BIGINT})")
    return f"list_transform([{hunks}], lambda h: h.o || {same})[1]"


def diff_text_sql(select: str) -> str:
    """A query over ``dt``: id, page_id, seq and diff_text of the changed versions."""
    head = _versions_sql()
    head = head[:head.index("SELECT id, page_id, seq, prev_id, cleaned_md,")]
    return head + f", dt AS (SELECT id, page_id, seq, {_diff_text_sql('ta', 'tb')} AS diff_text FROM fin WHERE has_changes)\n" + select


def _versions_sql(with_rows: bool = True) -> str:
    """SQL form of the batch version pipeline on the chain (F15 -> C7 -> G1/G2
    counts -> G5/G6 with parsed scores -> G7 -> F14/F17)."""
    from .q_text import _enhance_sql, _meta, _sql_clean, _sql_main
    norm = lambda e: Q.js_trim(f"replace(replace({e}, chr(13) || chr(10), chr(10)), chr(9), '  ')")
    score = (f"CAST(CASE WHEN TRY_CAST(regexp_extract(coalesce({Q.js_trim('sc.response')}, '2'), '^([+-]?[0-9]+)', 1)"
             f" AS BIGINT) BETWEEN 1 AND 4 THEN TRY_CAST(regexp_extract(coalesce({Q.js_trim('sc.response')}, '2'),"
             f" '^([+-]?[0-9]+)', 1) AS BIGINT) ELSE 2 END AS INTEGER)")
    return (with_views("d_chain", "d_score") + ", src AS (SELECT id AS k_id, text FROM d_chain)"
            + _sql_clean("src", "k_id", "text", "a") + ", c1 AS (SELECT k_id, text FROM aclean)" + _sql_main("c1", "b")
            + f"""
, cl AS (SELECT c.id, c.page_id, c.seq, {_meta('m.main_md')} AS cleaned_md FROM d_chain c JOIN bmain m ON m.k_id = c.id)
, p AS (SELECT *, lag(id) OVER w AS prev_id, lag(cleaned_md) OVER w AS prev_md FROM cl
        WINDOW w AS (PARTITION BY page_id ORDER BY seq, id))
, n AS (SELECT *, {norm('prev_md')} AS o, {norm('cleaned_md')} AS nn FROM p)
, t AS (SELECT *, {_tokens_sql('o')} AS ta, {_tokens_sql('nn')} AS tb FROM n)
, l AS (SELECT *, CASE WHEN prev_id IS NULL THEN NULL WHEN o = nn THEN len(tb) ELSE {_lcs_sql('ta', 'tb')} END AS lcs,
               len(ta) > 0 AND len(tb) > 0 AND ta[-1] = tb[-1] AS last_equal FROM t)
, u AS (SELECT *, CAST(lcs - CASE WHEN last_equal THEN 1 ELSE 0 END AS BIGINT) AS unchanged FROM l)
, cnt AS (SELECT *, CAST({_nl_sql('nn')} - unchanged AS BIGINT) AS additions,
                 CAST({_nl_sql('o')} - unchanged AS BIGINT) AS deletions FROM u)
, dec AS (SELECT cnt.*, additions > 0 OR deletions > 0 AS has_changes,
                 CASE WHEN additions + deletions + unchanged > 0
                      THEN (additions + deletions) / (additions + deletions + unchanged) * 100.0
                      WHEN prev_id IS NOT NULL THEN 0.0 END AS change_percentage,
                 {score} AS score
          FROM cnt LEFT JOIN d_score sc ON sc.id = cnt.id)
, fin AS (SELECT *, prev_id IS NULL AS is_new,
                 CAST(CASE WHEN prev_id IS NOT NULL AND NOT has_changes THEN NULL WHEN prev_id IS NULL THEN 4
                      ELSE score END AS SMALLINT) AS importance,
                 CASE WHEN prev_id IS NOT NULL AND NOT has_changes THEN 'No changes detected in diff'
                      WHEN prev_id IS NULL THEN 'New page'
                      ELSE 'Semantic importance: ' || CAST(score AS VARCHAR) || '/4' END AS reason FROM dec)
""" + ("""SELECT id, page_id, seq, prev_id, cleaned_md,
       CASE WHEN importance >= 2 THEN """ + _enhance_sql("cleaned_md") + """ ELSE cleaned_md END AS stored_md,
       additions, deletions, unchanged, has_changes, change_percentage, is_new, importance, reason,
       """ + Q.title("cleaned_md") + """ AS title,
       substr(CASE WHEN string_split(cleaned_md, chr(10))[1] <> '' THEN string_split(cleaned_md, chr(10))[1]
                   ELSE 'Page content' END, 1, 100) AS description,
       CASE WHEN length(cleaned_md) > 500 THEN substr(cleaned_md, 1, 500) ELSE '' END AS summary
FROM fin""" if with_rows else """SELECT seq, count(*) FILTER (WHERE reason = 'New page') AS new_pages,
       count(*) FILTER (WHERE importance IS NULL) AS unchanged,
       count(*) FILTER (WHERE importance = 1) AS minor,
       count(*) FILTER (WHERE importance >= 2 AND reason <> 'New page') AS significant
FROM fin GROUP BY seq"""))


@register("version_changes", "C7,G1,G2,G5,G6,G7,G8,G13,G14,F15,F16,F17,S8", sql=_versions_sql())
def q_version_changes(spark, sf):
    """Every chain version processed: diff counts against the previous
    version, decision, stored text, display fields. The SQL oracle computes
    the line LCS with a row-by-row dynamic programme."""
    return _versions(spark, sf)


def _stored_sql(chain: str = "d_chain", responses: str = "d_score") -> str:
    """The same with each version against the stored text of the one before it:
    one recursion step a version of a page."""
    from .q_text import _enhance_sql, _meta, _sql_clean, _sql_main
    norm = lambda e: Q.js_trim(f"replace(replace({e}, chr(13) || chr(10), chr(10)), chr(9), '  ')")
    response = Q.js_trim("sc.response")
    score = (f"CAST(CASE WHEN sc.id IS NULL THEN 2 WHEN TRY_CAST(regexp_extract(coalesce({response}, '2'), '^([+-]?[0-9]+)', 1) AS BIGINT) BETWEEN 1 AND 4"
             f" THEN TRY_CAST(regexp_extract(coalesce({response}, '2'), '^([+-]?[0-9]+)', 1) AS BIGINT) ELSE 2 END AS INTEGER)")
    lcs = f"CASE WHEN o = nn THEN len(tb) ELSE {_lcs_sql('ta', 'tb')} END"
    views = with_views(chain, responses)
    return (views.replace("WITH", "WITH RECURSIVE", 1) + f", src AS (SELECT id AS k_id, text FROM {chain})"
            + _sql_clean("src", "k_id", "text", "a") + ", c1 AS (SELECT k_id, text FROM aclean)" + _sql_main("c1", "b")
            + f"""
, cl AS (SELECT c.id, c.page_id, c.seq, {_meta('m.main_md')} AS cleaned_md FROM {chain} c JOIN bmain m ON m.k_id = c.id)
, v AS (SELECT cl.*, {_enhance_sql('cl.cleaned_md')} AS rich, {score} AS score, row_number() OVER (PARTITION BY page_id ORDER BY seq, cl.id) AS rn
        FROM cl LEFT JOIN {responses} sc ON sc.id = cl.id)
, r AS (
  SELECT id, page_id, seq, rn, NULL::BIGINT AS prev_id, false AS prev_enhanced, cleaned_md, rich AS stored_md, true AS kept_rich,
         NULL::BIGINT AS additions, NULL::BIGINT AS deletions, NULL::BIGINT AS unchanged, 4::SMALLINT AS importance, 'New page' AS reason
  FROM v WHERE rn = 1
  UNION ALL
  SELECT id, page_id, seq, rn, prev_id, prev_enhanced, cleaned_md, CASE WHEN importance >= 2 THEN rich ELSE cleaned_md END, coalesce(importance >= 2, false),
         additions, deletions, unchanged, importance,
         CASE WHEN importance IS NULL THEN 'No changes detected in diff' ELSE 'Semantic importance: ' || importance || '/4' END
  FROM (SELECT *, CAST(CASE WHEN additions > 0 OR deletions > 0 THEN score END AS SMALLINT) AS importance
        FROM (SELECT *, CAST({_nl_sql('nn')} - unchanged AS BIGINT) AS additions, CAST({_nl_sql('o')} - unchanged AS BIGINT) AS deletions
              FROM (SELECT *, CAST({lcs} - CASE WHEN len(ta) > 0 AND len(tb) > 0 AND ta[-1] = tb[-1] THEN 1 ELSE 0 END AS BIGINT) AS unchanged
                    FROM (SELECT *, {_tokens_sql('o')} AS ta, {_tokens_sql('nn')} AS tb
                          FROM (SELECT v.*, r.id AS prev_id, r.kept_rich AS prev_enhanced, {norm('r.stored_md')} AS o, {norm('v.cleaned_md')} AS nn
                                FROM r JOIN v ON v.page_id = r.page_id AND v.rn = r.rn + 1)))))
)
SELECT id, page_id, seq, prev_id, prev_enhanced, cleaned_md, stored_md, additions, deletions, unchanged, additions > 0 OR deletions > 0 AS has_changes,
       CASE WHEN additions + deletions + unchanged > 0 THEN (additions + deletions) / (additions + deletions + unchanged) * 100.0
            WHEN prev_id IS NOT NULL THEN 0.0 END AS change_percentage,
       prev_id IS NULL AS is_new, importance, reason, {Q.title('cleaned_md')} AS title,
       substr(CASE WHEN string_split(cleaned_md, chr(10))[1] <> '' THEN string_split(cleaned_md, chr(10))[1] ELSE 'Page content' END, 1, 100) AS description,
       CASE WHEN length(cleaned_md) > 500 THEN substr(cleaned_md, 1, 500) ELSE '' END AS summary
FROM r""")


@register("version_changes_stored", "C7,G1,G2,G5,G6,G7,G8,G13", sql=_stored_sql())
def q_version_changes_stored(spark, sf):
    """Every chain version compared with the *stored* text of the version before
    it, which may be the enhanced one (SURVEY Q4)."""
    return stored_versions(D.version_chain(spark, sf), scores=D.scorer_responses(spark, sf))


@register("recrawl_changes_stored", "C7,G1,G2,G5,G6,G7,G8,G13", sql=_stored_sql("d_rechain", "d_rescore"))
def q_recrawl_changes_stored(spark, sf):
    """Pages crawled again without a change: the cleaned text differs from a stored
    text that was enhanced, and no longer from one that was not."""
    return stored_versions(D.recrawl_chain(spark, sf), scores=D.recrawl_responses(spark, sf))


@register("version_diff_text", "G4", sql=diff_text_sql("SELECT id, page_id, seq, diff_text FROM dt"))
def q_version_diff_text(spark, sf):
    v = _versions(spark, sf, with_text=True)
    return v.filter(F.col("has_changes")).select("id", "page_id", "seq", "diff_text")


@register("change_breakdown", "D8", sql=_versions_sql(with_rows=False))
def q_change_breakdown(spark, sf):
    """Per crawl round (chain position): new / unchanged / score 1 / score 2+."""
    return G.change_breakdown(_versions(spark, sf), key="seq")


_NORM_DIFF = Q.js_trim("replace(replace({c}, chr(13) || chr(10), chr(10)), chr(9), '  ')")


@register("bag_diff_chain", "G3,C7", sql=with_views("d_chain") + f"""
, p AS (SELECT id, text, lag(text) OVER (PARTITION BY page_id ORDER BY seq, id) AS prev_text FROM d_chain)
, pr AS (SELECT id, {_NORM_DIFF.format(c='prev_text')} AS o, {_NORM_DIFF.format(c='text')} AS n FROM p
         WHERE prev_text IS NOT NULL)
, l AS (SELECT id, unnest(CASE WHEN o = '' THEN [] ELSE string_split(o, chr(10)) END) AS line, 0 AS side FROM pr
        UNION ALL
        SELECT id, unnest(CASE WHEN n = '' THEN [] ELSE string_split(n, chr(10)) END) AS line, 1 AS side FROM pr)
, c AS (SELECT id, line, count(*) FILTER (WHERE side = 0) AS o, count(*) FILTER (WHERE side = 1) AS n
        FROM l GROUP BY id, line)
, a AS (SELECT id, sum(n - least(o, n)) AS ad, sum(o - least(o, n)) AS de, sum(least(o, n)) AS un FROM c GROUP BY id)
SELECT pr.id, CAST(coalesce(a.ad, 0) AS BIGINT) AS bag_additions, CAST(coalesce(a.de, 0) AS BIGINT) AS bag_deletions,
       CAST(coalesce(a.un, 0) AS BIGINT) AS bag_unchanged
FROM pr LEFT JOIN a ON a.id = pr.id""")
def q_bag_diff(spark, sf):
    c = G.previous_version(D.version_chain(spark, sf), "page_id", ["seq", "id"], ["text"])
    pairs = c.filter(F.col("prev_text").isNotNull()).select("id", "prev_text", "text")
    return G.bag_diff(pairs, ["id"], "prev_text", "text")


_FP_CLASS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


class _Fpn:
    @staticmethod
    def format(c: str) -> str:
        return Q.js_trim(Q.rx(f"lower({c})", _FP_CLASS, "' '"))


_FPN = _Fpn()


def _sim_sql(a: str, b: str) -> str:
    na, nb = _FPN.format(c=a), _FPN.format(c=b)
    ta, tb = f"list_distinct(string_split({na}, ' '))", f"list_distinct(string_split({nb}, ' '))"
    ls = f"(1.0 - abs(length({na}) - length({nb})) / greatest(length({na}), length({nb})))"
    jac = f"(len(list_intersect({ta}, {tb})) / len(list_distinct(list_concat({ta}, {tb}))))"
    return (f"CASE WHEN {a} = {b} THEN 1.0 WHEN coalesce({a}, '') = '' THEN 0.0 WHEN coalesce({b}, '') = '' THEN 0.0 "
            f"WHEN greatest(length({na}), length({nb})) = 0 THEN 1.0 ELSE {ls} * 0.3 + {jac} * 0.7 END")


@register("similarity_chain", "G10,G11,C7", sql=with_views("d_chain", "d_profile") + f"""
, p AS (SELECT id, page_id, text, lag(text) OVER (PARTITION BY page_id ORDER BY seq, id) AS prev_text FROM d_chain)
, s AS (SELECT p.id, page_id, {_sim_sql('prev_text', 'text')} AS similarity,
               coalesce(CAST(json_extract_string(f.params, '$.similarityThreshold') AS DOUBLE), 0.95) AS threshold
        FROM p LEFT JOIN d_profile f ON f.id = p.page_id % 25 WHERE prev_text IS NOT NULL)
SELECT id, page_id, similarity, similarity < 0.95 AS changed,
       CASE WHEN similarity < 0.95 THEN 'Content changed by ' || CAST(CAST(floor((1.0 - similarity) * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'
            ELSE 'Content similarity ' || CAST(CAST(floor(similarity * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% (above 95% threshold)' END AS reason,
       similarity < threshold AS changed_profile
FROM s""")
def q_similarity(spark, sf):
    c = G.previous_version(D.version_chain(spark, sf), "page_id", ["seq", "id"], ["text"])
    s = c.filter(F.col("prev_text").isNotNull()).select(
        "id", "page_id", G.similarity(F.col("prev_text"), F.col("text")).alias("similarity"))
    changed, reason = G.changed_enough(F.col("similarity"), F.lit(0.95))
    # each page's profile (page_id % 25) has its own threshold
    profile = D.profiles(spark, sf).select(F.col("id").alias("_p"), "params")
    s = s.join(profile, F.col("page_id") % 25 == F.col("_p"), "left")
    changed_p, _ = G.changed_enough(F.col("similarity"), G.profile_threshold(F.col("params")))
    return s.select("id", "page_id", "similarity", changed.alias("changed"), reason.alias("reason"),
                    changed_p.alias("changed_profile"))


@register("score_parsing", "G8", sql=with_views("d_score") + f"""
SELECT id, response,
       CAST(CASE WHEN TRY_CAST(regexp_extract(coalesce({Q.js_trim('response')}, '2'), '^([+-]?[0-9]+)', 1) AS BIGINT)
                      BETWEEN 1 AND 4
                 THEN TRY_CAST(regexp_extract(coalesce({Q.js_trim('response')}, '2'), '^([+-]?[0-9]+)', 1) AS BIGINT)
                 ELSE 2 END AS INTEGER) AS score
FROM d_score""")
def q_score_parsing(spark, sf):
    s = D.scorer_responses(spark, sf)
    return s.select("id", "response", G.parse_score(F.col("response")).alias("score"))


@register("new_pages_and_fingerprints", "G5,G9,C7,M3", sql=with_views("d_chain") + f"""
, f AS (SELECT id, page_id, seq, sha256({_FPN.format(c='text')}) AS fingerprint FROM d_chain)
SELECT id, page_id, fingerprint,
       lag(id) OVER (PARTITION BY page_id ORDER BY seq, id) AS prev_id,
       lag(id) OVER (PARTITION BY page_id ORDER BY seq, id) IS NULL AS is_new,
       coalesce(lag(fingerprint) OVER (PARTITION BY page_id ORDER BY seq, id) = fingerprint, false) AS same_as_prev,
       last_value(id) OVER (PARTITION BY page_id ORDER BY seq, id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_version_id
FROM f""")
def q_new_pages(spark, sf):
    c = D.version_chain(spark, sf).withColumn("fingerprint", TX.fingerprint(F.col("text")))
    last = c.groupBy("page_id").agg(F.max(F.struct("seq", "id"))["id"].alias("last_version_id"))
    c = G.previous_version(c, "page_id", ["seq", "id"], ["id", "fingerprint"])
    return c.join(last, "page_id").select("id", "page_id", "fingerprint", "prev_id", F.col("prev_id").isNull().alias("is_new"),
                    F.coalesce(F.col("prev_fingerprint") == F.col("fingerprint"), F.lit(False)).alias("same_as_prev"),
                    "last_version_id")


@register("near_duplicate_groups", "G12", sql=None)
def q_near_groups(spark, sf):
    """MinHash/LSH grouping of the whole document corpus (approximate: rows-only)."""
    from ..operators.nearmatch import near_match_groups
    from ..sources.tables import read_table
    return near_match_groups(read_table(spark, sf, "documents"), "doc_id", "text")


@register("near_groups_by_cosine", "G12", sql=f"""
WITH RECURSIVE base AS (SELECT doc_id, {_FPN.format(c="coalesce(text, '')")} AS nt FROM documents)
, cls AS (SELECT min(doc_id) AS k, nt FROM base GROUP BY nt)
, s AS (SELECT k, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g
        FROM (SELECT k, string_split(nt, ' ') AS ws FROM cls))
, v AS (SELECT k, g, count(*) AS n FROM s GROUP BY k, g)
, q AS (SELECT k, sum(n * n) AS q FROM v GROUP BY k)
, d AS (SELECT a.k AS x, b.k AS y, sum(a.n * b.n) AS d FROM v a JOIN v b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k)
, l AS (SELECT x, y FROM d JOIN q qx ON qx.k = x JOIN q qy ON qy.k = y WHERE d * d * 10000 >= 6400 * qx.q * qy.q)
, e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l)
, r AS (SELECT k AS a, k AS b FROM cls UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
, g AS (SELECT a, min(b) AS root FROM r GROUP BY a)
SELECT base.doc_id, g.root AS group_id, g.root <> base.doc_id AS near_copy FROM base JOIN cls USING (nt) JOIN g ON g.a = cls.k""")
def q_near_groups_by_cosine(spark, sf):
    """Groups of documents whose vectors of five-word shingles have a cosine of 0.8
    or more: exact."""
    from ..operators.cosine import cosine_groups
    from ..sources.tables import read_table
    return cosine_groups(read_table(spark, sf, "documents"), "doc_id", "text")


def _backfill_sql() -> str:
    from .q_text import _meta, _sql_clean, _sql_main

    def desc(e):
        return (f"substr(CASE WHEN string_split({e}, chr(10))[1] <> '' THEN string_split({e}, chr(10))[1] "
                f"ELSE 'Page content' END, 1, 100)")

    def summ(e):
        return f"CASE WHEN length({e}) > 500 THEN substr({e}, 1, 500) ELSE '' END"
    return (with_views("d_chain") + ", src AS (SELECT id AS k_id, text FROM d_chain WHERE (page_id + seq) % 4 = 0)"
            + _sql_clean("src", "k_id", "text", "a") + ", c1 AS (SELECT k_id, text FROM aclean)" + _sql_main("c1", "b")
            + f"""
, f AS (SELECT k_id AS id, {_meta('main_md')} AS md FROM bmain)
SELECT id, {Q.title('md')} AS title, {desc('md')} AS description, {summ('md')} AS summary, true AS backfilled FROM f
UNION ALL
SELECT id, {Q.title('text')}, {desc('text')}, {summ('text')}, false FROM d_chain WHERE (page_id + seq) % 4 <> 0""")


@register("metadata_backfill", "G15,F15,F14,F17", sql=_backfill_sql())
def q_backfill(spark, sf):
    """Versions without title, description and summary get them from their
    cleaned text; versions that have them keep theirs. Missing metadata is
    spelled by (page_id + seq) % 4 = 0 on the chain (fixed rule)."""
    from ..operators.text_ops import clean_pipeline
    c = D.version_chain(spark, sf)
    missing = (F.col("page_id") + F.col("seq")) % 4 == 0
    have = c.select("id", "text", F.when(~missing, TX.extract_title(F.col("text"))).alias("title"),
                    F.when(~missing, TX.deterministic_description(F.col("text"))).alias("description"),
                    F.when(~missing, TX.deterministic_summary(F.col("text"))).alias("summary"))
    lacking = F.col("description").isNull() & F.col("summary").isNull()
    todo = clean_pipeline(have.filter(lacking), "text", "cleaned_md", extract_main=True)
    filled = todo.select("id", TX.extract_title(F.col("cleaned_md")).alias("title"),
                         TX.deterministic_description(F.col("cleaned_md")).alias("description"),
                         TX.deterministic_summary(F.col("cleaned_md")).alias("summary"),
                         F.lit(True).alias("backfilled"))
    kept = have.filter(~lacking).select("id", "title", "description", "summary", F.lit(False).alias("backfilled"))
    return kept.unionByName(filled)
