"""Work done job by job: tasks follow the rows, and rows dealt by job stay in place."""

import re

import pytest
from pyspark.sql import functions as F

from sitegrove.operators import assemble as A
from sitegrove.operators import catalog as C
from sitegrove.operators import text_ops
from sitegrove.plans import q_assemble as Q
from sitegrove.plans.all import REGISTRY
from sitegrove.sources import derived as D
from sitegrove.sources import tables

ROWS = 400


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """100 jobs of 4 pages, of 10 domains; 30 parts."""
    d = str(tmp_path_factory.mktemp("sf"))
    spark.sql("SELECT id AS c_custkey, 'X' AS c_mktsegment, CAST(id AS INT) AS c_nationkey, 1.0D AS c_acctbal FROM range(10)").write.parquet(f"{d}/customer.parquet")
    spark.sql("SELECT id AS n_nationkey, CAST(id AS INT) AS n_regionkey, 'N' AS n_name FROM range(10)").write.parquet(f"{d}/nation.parquet")
    spark.sql("SELECT id AS p_partkey, concat('part ', id) AS p_name, 'T' AS p_type, 'B' AS p_brand FROM range(30)").write.parquet(f"{d}/part.parquet")
    spark.sql("""SELECT id AS o_orderkey, id % 10 AS o_custkey, 'F' AS o_orderstatus, '2-HIGH' AS o_orderpriority,
                 TIMESTAMP_NTZ '2024-01-01 00:00:00' AS o_orderdate FROM range(100)""").write.parquet(f"{d}/orders.parquet")
    spark.sql(f"""SELECT id DIV 4 AS l_orderkey, id * 7 % 30 AS l_partkey, CAST(id % 4 + 1 AS INT) AS l_linenumber, 'R' AS l_returnflag,
                 TIMESTAMP_NTZ '2024-01-02 00:00:00' AS l_shipdate FROM range({ROWS})""").write.parquet(f"{d}/lineitem.parquet")
    return d


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range|RoundRobin)", _plan(df)))


@pytest.mark.parametrize("table", [D.job_page_versions, D.job_page_details])
def test_tasks_follow_the_rows(spark, sf, monkeypatch, table):
    for per_task in (40, 10):
        monkeypatch.setattr(tables, "ROWS_PER_TASK", per_task)
        n = max(spark.sparkContext.defaultParallelism, ROWS // per_task)
        assert table(spark, sf).rdd.getNumPartitions() == n
        assert C.first_pages(table(spark, sf)).rdd.getNumPartitions() == n


def test_details_equal_the_plain_joins(spark, sf):
    plain = Q._with_domain(spark, sf, D.page_version_details(spark, sf))
    job = D.job_page_details(spark, sf).select(plain.columns)
    assert job.exceptAll(plain).isEmpty() and plain.exceptAll(job).isEmpty() and job.count() == ROWS


def test_by_job_steps_need_no_other_shuffle(spark, sf):
    det = Q._details(spark, sf)
    own = _shuffles(det)
    assert own <= 5  # both sides by job; at most both of part and domain
    assert _shuffles(A.full_document(det, "2024-02-01 00:00:00")) == own
    assert _shuffles(A.index_document(det, "2024-02-01 00:00:00")) == own
    assert _shuffles(A.categorized_pages(det)) <= own


def test_orphan_report_tells_apart_orphan_pages_only(spark, sf):
    got = REGISTRY["orphan_report"].build(spark, sf)
    # the aggregate of pages stands above the anti join
    p = got._jdf.queryExecution().optimizedPlan().toString()
    at = re.search(r"Aggregate \[(?:domain_id|o_custkey)[^\n]*\n(.*?)\n", p)
    assert at and "LeftAnti" in p[at.start():at.start() + 2000]
    assert {r.orphans for r in got.collect()} == {0}


def test_artifact_rows_keep_lengths_not_texts(spark):
    docs = spark.createDataFrame([(1, "a.example", "llms_txt", "x" * 9), (2, "a.example", "llms_txt", "xy"), (3, "a.example", "llms_txt", None)],
                                 "job_id long, domain string, kind string, content string")
    jobs = spark.sql("SELECT id, 5L AS domain_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS started_at FROM range(1, 4)")
    got = A.artifact_rows(docs, jobs, spark.createDataFrame([(5, "llms_txt", 3)], "domain_id long, kind string, version int"))
    assert not re.search(r"\bcontent#", _plan(got))
    assert sorted((r.job_id, r.version, r.content_chars) for r in got.collect()) == [(1, 4, 9), (2, 5, 2)]


def test_short_pattern_lists_make_no_substrings(spark):
    urls = [(j, f"https://s.example/{p}/{j}") for j in range(4) for p in ("docs/a", "blog", "docs-blog", "étage")]
    pats = [(j, p) for j in range(4) for p in ("docs", "blog/", "s.example/docs/a", "zz")][:13]
    u, p = spark.createDataFrame(urls, "job_id long, url string"), spark.createDataFrame(pats, "job_id long, pattern string")
    exp = sorted((j, x, y) for j, x in urls for i, y in pats if i == j and y in x)
    near = A._contained(u, p, 8)
    assert "sequence(" not in _plan(near)
    for listed in (64, 3, 0):
        assert sorted(map(tuple, A._contained(u, p, 8, listed).collect())) == exp


def test_pages_are_extracted_in_slices(spark, monkeypatch):
    assert text_ops.slices([], 5) == [(0, 0)] and text_ops.slices([3, 3, 9, 0, 1, 4], 5) == [(0, 1), (1, 2), (2, 3), (3, 6)]
    texts = [None if i % 7 == 0 else "\n".join(["# Docs" if k % 5 == i % 5 else "line " * (k + i) for k in range(20)]) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    whole = df.select("id", text_ops.main_content(F.col("t")).alias("m")).collect()
    monkeypatch.setattr(text_ops, "CHARS_AT_ONCE", 50)
    held = []
    one = text_ops._extract
    monkeypatch.setattr(text_ops, "_extract", lambda x, d: held.append(len(x)) or one(x, d))
    import pandas as pd
    cut = text_ops._extract_udf(False).func(pd.Series(texts))
    assert len(held) > 20 and [None if x is None else x for x in cut.text] == [r.m.text for r in whole]


def test_categorized_documents_are_made_where_the_pages_are(spark, sf, monkeypatch):
    """Sections are dealt by job once: not stored, not dealt again, and met once by the lists of categories."""
    names = []
    for m in (A, Q):
        monkeypatch.setattr(m, "stored", lambda df, name, f=m.stored: names.append(name) or f(df, name))
    got = REGISTRY["full_documents_categorized"].build(spark, sf)
    assert names == ["categories"]
    assert _shuffles(got) <= _shuffles(Q._details(spark, sf)) + 1
    assert {r.job_id for r in got.collect()} == set(range(100))


def test_versions_travel_as_the_table_has_them(spark, sf):
    """To their part and to their job: what is made of a version's columns is made after that."""
    p = _plan(A.url_sections(Q._details(spark, sf)))
    at = p.index("hashpartitioning(l_orderkey")
    assert not re.search(r"l_orderkey#\w+ \* 8", p[at:]) and "l_linenumber" in p[at:]


CATEGORIES = [(0, "Docs", 0, ["/docs", "zz"]), (0, "Docs", 0, ["/docs", "zz"]), (0, "All", 1, None), (0, "10", 2, ["/blog"]), (0, "2", 3, ["/none"]),
              (1, "Empty", 0, []), (1, "Blog", 4, ["blog", "/blog/1"]), (2, "None", 0, ["/none"]), (4, "Any", 1, [""]), (9, "Elsewhere", 0, ["/"])]
SECTIONS = [(j, f"d{j}.example", None if i == 5 else f"https://d{j}.example/{('docs', 'blog')[i % 2]}/{i}", 1 + i % 2, f"### {i}\n\n---\n\n")
            for j in range(5) for i in range(6)]


@pytest.mark.parametrize("limit", [10**9, 14, 0])
def test_matches_of_pages_dealt_by_job(spark, limit):
    pages = spark.createDataFrame(SECTIONS, "job_id long, domain string, url string, n_url long, section string")
    parsed = spark.createDataFrame(CATEGORIES, "job_id long, category string, cat_pos int, patterns array<string>")
    dealt = pages.repartition(4, "job_id")
    counts = pages.groupBy("job_id").agg(F.count(F.lit(1)).alias("pages"))
    got = A.match_categories(dealt, parsed, pair_limit=limit, tasks=4, per_job=counts)
    assert got.columns == [*pages.columns, "category", "cat_pos"]
    exp = {(*p, c, k) for p in SECTIONS for j, c, k, ps in CATEGORIES if j == p[0] and p[2] is not None and any(x in p[2] for x in ([""] if ps is None else ps))}
    exp |= {(j, f"d{j}.example", None, 0, None, c, k) for j in range(5) for i, c, k, _ in CATEGORIES if i == j}
    exp.add((3, "d3.example", None, 0, None, None, None))  # a job without categories
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(exp) and set(rows) == exp
    # the same documents as by an assignment and a list of categories
    plain = A.match_categories(pages, parsed)
    docs = A.full_document_of(pages, "2024-02-01 00:00:00", plain, parsed.select("job_id", "category", "cat_pos").distinct())
    key = lambda r: r.job_id
    found = sorted(A.full_document_of(got, "2024-02-01 00:00:00").collect(), key=key)
    assert found == sorted(docs.collect(), key=key) and [r.categories for r in found] == [4, 2, 1, 0, 1]
    assert "- [2](#2) (0 pages)\n- [10](#10) (4 pages)\n- [Docs](#docs) (3 pages)\n- [All](#all) (7 pages)\n" in found[0].content


def test_counts_leave_no_shuffle_files(spark):
    from sitegrove.session import shuffles_dropped
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    with shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == was
