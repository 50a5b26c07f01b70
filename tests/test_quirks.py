"""Literal fixtures for the reference's quirks and decisions."""

from pyspark.sql import functions as F

from sitegrove import AS_OF
from sitegrove.operators import assemble as A
from sitegrove.operators import catalog as C
from sitegrove.operators import jobstate as J
from sitegrove.operators import schedule as K
from sitegrove.operators import text_ops as X

TS = "timestamp_ntz"


def _jobs(spark, rows):
    return spark.createDataFrame(rows, "id long, domain_id long, status string, started_at string, finished_at string") \
        .withColumn("started_at", F.col("started_at").cast(TS)).withColumn("finished_at", F.col("finished_at").cast(TS))


def _domains(spark, rows):
    return spark.createDataFrame(rows, "id long, domain string, check_interval_minutes int, is_active boolean")


def test_q1_null_importance_counts_as_changed(spark):
    v = spark.createDataFrame([(1, 10, None), (1, 11, 1), (1, 12, 3)], "job_id long, page_id long, importance smallint")
    r = C.version_counts(v).first()
    assert (r.total, r.changed, r.skipped) == (3, 2, 1)


def test_d2_average_null_when_no_scores(spark):
    jobs = _jobs(spark, [(1, 1, "finished", "2024-01-01 00:00:00", "2024-01-01 00:29:31")])
    v = spark.createDataFrame([(1, 10, None), (1, 10, None)], "job_id long, page_id long, importance smallint")
    a = spark.createDataFrame([], "job_id long, id long")
    r = C.final_job_stats(jobs, v, a, AS_OF).first()
    assert r.average_importance is None and r.unique_pages == 1 and r.duration_minutes == 30


def test_q9_latest_finished_job_without_artifacts_hides_older(spark):
    jobs = _jobs(spark, [(1, 7, "finished", "2024-01-01 00:00:00", "2024-01-01 01:00:00"),
                         (2, 7, "finished", "2024-01-02 00:00:00", "2024-01-02 01:00:00")])
    arts = spark.createDataFrame([(100, 1, 7, "llms_txt", 1, "2024-01-01 01:00:00")],
                                 "id long, job_id long, domain_id long, kind string, version int, created_at string") \
        .withColumn("created_at", F.col("created_at").cast(TS))
    cur = {r.kind: r.id for r in C.current_artifacts(arts, jobs).collect()}
    assert cur == {"llms_txt": None, "llms_full_txt": None}
    fb = {r.kind: r.id for r in C.current_artifacts(arts, jobs, fallback=True).collect()}
    assert fb == {"llms_txt": 100, "llms_full_txt": None}


def test_q16_two_due_rules(spark):
    doms = _domains(spark, [(1, "a.com", 60, True), (2, "b.com", 60, True), (3, "c.com", 60, True)])
    jobs = _jobs(spark, [(10, 2, "finished", "2024-01-31 20:00:00", "2024-01-31 22:59:30"),
                         (11, 3, "processing", "2024-01-31 10:00:00", None),
                         (12, 3, "finished", "2024-01-30 10:00:00", "2024-01-30 11:00:00")])
    k1 = {r.id for r in K.due_domains_scheduled(doms, jobs, AS_OF).collect()}
    k2 = {r.id for r in K.due_domains_service(doms, jobs, AS_OF).collect()}
    # K1: never crawled is not due; 60.5 minutes floor to 60 -> due; ongoing job excluded
    assert k1 == {2}
    # K2: never crawled is due; latest job unfinished -> not due; millisecond compare
    assert k2 == {1, 2}


def test_q11_q12_categories(spark):
    det = spark.createDataFrame([
        (1, "d.com", 1, "https://d.com/blog/x", "X", None, None, "2024-01-01 00:00:00"),
        (1, "d.com", 2, "https://d.com/10/y", "Y", "dy", None, "2024-01-01 00:00:00"),
        (1, "d.com", 3, "https://d.com/2/z", "", None, "sz", "2024-01-01 00:00:00"),
        (1, "d.com", 4, "https://d.com/", "R", None, None, "2024-01-01 00:00:00")],
        "job_id long, domain string, id long, url string, title string, description string, summary string, "
        "created_at string").withColumn("created_at", F.col("created_at").cast(TS))
    doc = A.full_document(det, AS_OF).first().content
    toc = [l for l in doc.split("\n") if l.startswith("- [")]
    # integer-like names first ascending, then first-seen order (root by url '/' sorts before 'blog')
    assert toc == ["- [2](#2) (1 pages)", "- [10](#10) (1 pages)", "- [root](#root) (1 pages)",
                   "- [blog](#blog) (1 pages)"]
    assert "### z\n\nsz\n\n---" in doc and "> dy" in doc
    # a page can match several categories or none
    pages = A.categorized_pages(det).select("job_id", "url", "pos")
    resp = spark.createDataFrame([(1, '{"Blog": ["/blog"], "All": ["d.com"], "None": ["/nothing"], "Bad": "x"}')],
                                 "job_id long, response string")
    hits = A.match_categories(pages, A.parse_category_response(resp))
    by_url = {}
    for r in hits.collect():
        by_url.setdefault(r.url, set()).add(r.category)
    assert by_url["https://d.com/blog/x"] == {"Blog", "All"}
    assert all("None" not in c and "Bad" not in c for c in by_url.values())


def test_q15_double_kept_lines_and_option():
    long_line = "z" * 120
    text = "\n".join(["short"] * 3 + [long_line, long_line, "next line"])
    # the first long line opens depth (kept once); the second is kept by both rules
    assert X.main_content_lines(text) == [long_line, long_line, long_line, "next line"]
    assert X.main_content_lines(text, dedupe=True) == [long_line, long_line, "next line"]


def test_q21_first_terminal_event_wins(spark):
    """M4: a stored terminal state absorbs the log; stats are replaced (finish,
    fail, cancel) or merged (complete)."""
    jobs = _jobs(spark, [(1, 1, "processing", "2024-01-01 00:00:00", None), (2, 1, "processing", "2024-01-01 00:00:00", None),
                         (3, 1, "finished", "2024-01-01 00:00:00", "2024-01-01 09:00:00"),
                         (4, 1, "failed", "2024-01-01 00:00:00", "2024-01-01 08:00:00"),
                         (5, 1, "processing", "2024-01-01 00:00:00", None)]).withColumn("stats", F.lit('{"a":1,"b":2}'))
    term = spark.createDataFrame(
        [(1, "2024-01-02 00:00:00", "canceled", '{"reason":"x"}', False), (1, "2024-01-03 00:00:00", "finished", '{"b":9}', True),
         (3, "2024-01-02 00:00:00", "canceled", '{"reason":"x"}', False), (5, "2024-01-02 00:00:00", "finished", '{"b":9,"c":3}', True)],
        "job_id long, ts string, status string, stats string, merge boolean").withColumn("ts", F.col("ts").cast(TS))
    out = {r.job_id: (r.status, str(r.finished_at), r.stats) for r in J.fold_job_state(jobs, term).collect()}
    assert out == {1: ("canceled", "2024-01-02 00:00:00", '{"reason":"x"}'), 2: ("processing", "None", '{"a":1,"b":2}'),
                   3: ("finished", "2024-01-01 09:00:00", '{"a":1,"b":2}'), 4: ("failed", "2024-01-01 08:00:00", '{"a":1,"b":2}'),
                   5: ("finished", "2024-01-02 00:00:00", '{"a":1,"b":9,"c":3}')}


def test_k5_only_free_slots(spark):
    jobs = _jobs(spark, [(i, 100 + i, "processing", "2024-01-01 00:00:00", None) for i in range(3)])
    req = spark.createDataFrame([(d, f"2024-01-0{d} 00:00:00", d) for d in (1, 2, 3, 4)], "domain_id long, requested_at string, request_id long") \
        .withColumn("requested_at", F.col("requested_at").cast(TS))
    assert [r.domain_id for r in K.admit_crawls(req, jobs, 5).collect()] == [1, 2]
    assert K.admit_crawls(req, jobs, 3).count() == 0


def test_r3_pages_go_with_their_last_job(spark):
    from sitegrove.operators import catalog as C
    jobs = spark.createDataFrame([(1,), (2,)], "id long")
    versions = spark.createDataFrame([(10, 7, 1), (11, 7, 2), (12, 8, 1), (13, 8, 1), (14, 9, 2), (15, 9, 1)], "id long, page_id long, job_id long")
    pages = spark.createDataFrame([(7, 2), (8, 1), (9, 1)], "page_id long, job_id long")
    arts = spark.createDataFrame([(1, 2)], "id long, job_id long")
    left = C.cascade_delete_jobs(jobs, versions, arts, spark.createDataFrame([(2,)], "id long"), pages)
    assert sorted(r.id for r in left["versions"].collect()) == [12, 13, 15]  # 10 goes with its page
    assert sorted(r.page_id for r in left["pages"].collect()) == [8, 9] and left["artifacts"].count() == 0


def test_h7_category_responses(spark):
    from sitegrove.operators import assemble as A
    rows = [(1, None), (2, ""), (3, '[["/a"], 5, ["/b", null]]'), (4, "null"), (5, "not json"), (6, '{"A": ["/a"], "B": "/b", "C": []}'), (7, "12"), (8, '"text"')]
    out = {}
    for r in A.parse_category_response(spark.createDataFrame(rows, "job_id long, response string")).collect():
        out.setdefault(r.job_id, []).append((r.cat_pos, r.category, r.patterns))
    assert {k: sorted(v) for k, v in out.items()} == {
        3: [(0, "0", ["/a"]), (2, "2", ["/b", "null"])], 4: [(0, "Pages", None)], 5: [(0, "Pages", None)],
        6: [(0, "A", ["/a"]), (2, "C", [])]}
    pages = spark.createDataFrame([(i, "https://x/a") for i in (3, 5, 6)], "job_id long, url string")
    hits = A.match_categories(pages, A.parse_category_response(spark.createDataFrame(rows, "job_id long, response string"))).collect()
    assert sorted((r.job_id, r.category) for r in hits) == [(3, "0"), (5, "Pages"), (6, "A")]


def test_f4_adjacent_sections_and_no_break_space(spark):
    from sitegrove.functions import text as TX
    rows = [(1, "intro\n## Menu\nx\n## Footer\ny\n# Real\nz"), (2, "a\n##\u00a0Menu\nb\n#\u00a0Real\nc"), (3, "#\u3000Title here\nx")]
    df = spark.createDataFrame(rows, "id long, t string")
    out = {r.id: (r.f4, r.title) for r in df.select("id", TX.drop_boilerplate_sections(F.col("t")).alias("f4"), TX.extract_title(F.col("t")).alias("title")).collect()}
    assert out[1][0] == "intro\n\n\n# Real\nz" and out[2][0] == "a\n\n#\u00a0Real\nc" and out[3][1] == "Title here"


def test_q7_one_trigger_per_job(spark):
    ev = spark.createDataFrame([
        (1, "2024-01-01 00:00:00", 1), (1, "2024-01-01 00:00:05", 2), (1, "2024-01-01 00:00:06", 3),
        (1, "2024-01-01 00:00:07", 1), (1, "2024-01-01 00:00:09", 2),             # reopened, ready again
        (2, "2024-01-01 00:00:00", 3),                                              # closed, no pages: never
        (3, "2024-01-01 00:00:00", 1), (3, "2024-01-01 00:00:01", 3), (3, "2024-01-01 00:00:02", 2)],
        "job_id long, ts string, kind int").withColumn("ts", F.col("ts").cast(TS))
    out = {r.job_id: (r.fired_by, r.completed_pages) for r in J.ready_triggers(ev).collect()}
    assert out == {1: ("close", 1), 3: ("last_page", 1)}


def test_b7_request_verdicts(spark):
    doms = _domains(spark, [(1, "a.com", 60, True), (2, "b.com", 60, False), (3, "c.com", 60, True)])
    jobs = _jobs(spark, [(10, 3, "processing", "2024-01-01 00:00:00", None)])
    req = spark.createDataFrame([(1, "https://www.a.com/"), (2, "http://b.com/x"), (3, "c.com"), (4, "localhost"),
                                 (5, "https://new.org/docs")], "request_id long, url string")
    out = {r.request_id: (r.verdict, r.is_new_domain) for r in K.validate_crawl_requests(req, doms, jobs).collect()}
    assert out == {1: ("accepted", False), 2: ("rejected_inactive", False), 3: ("conflict", False),
                   4: ("invalid", True), 5: ("accepted", True)}


def test_ready_trigger_buckets_do_not_change_result(spark, sf_small):
    from sitegrove.plans.q_events import event_pipeline
    ev = event_pipeline(spark, sf_small)["events"]
    fine = J.ready_triggers(ev, bucket="minute")
    coarse = J.ready_triggers(ev, bucket="year")
    assert fine.count() > 0
    assert fine.exceptAll(coarse).count() == 0 and coarse.exceptAll(fine).count() == 0
