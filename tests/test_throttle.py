"""S4 with carry-over, K5 by rank, C6 through the index, stored aggregates (D1, D2,
D10, S6): each against a plain loop."""

import random
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sitegrove.operators import assemble as A
from sitegrove.operators import jobstate as J
from sitegrove.operators import schedule as K
from sitegrove.streaming import state_tables as ST

T0 = datetime(2024, 1, 1)


def _queue(stamps, seconds, limit):
    """First come first served, ``limit`` starts a window: seconds that each waits."""
    out, started = [], {}
    w = None
    for t in sorted(stamps):
        own = int((t - datetime(1970, 1, 1)).total_seconds()) // seconds
        w = own if w is None else max(w, own)
        while started.get(w, 0) >= limit:
            w += 1
        started[w] = started.get(w, 0) + 1
        out.append((t, (w - own) * seconds))
    return out


def test_backlog_and_delays(spark):
    rnd = random.Random(4)
    at, stamps = T0, []
    for _ in range(400):
        # bursts, quiet spells of hours, and windows at the edge of a bucket
        at += timedelta(seconds=rnd.choice([0, 0, 0, 1, 1, 3, 9, 11, 40, 3599, 7300]) if rnd.random() < 0.3 else rnd.choice([0, 1]))
        stamps.append(at)
    rows = [(t, i, 0, 1, f"u{i}") for i, t in enumerate(stamps)]
    pages = spark.createDataFrame(rows, "ts timestamp_ntz, event_id long, doc_pos int, job_id long, url string").repartition(4)
    for limit in (1, 2, 5):
        exp = _queue(stamps, 10, limit)
        got = sorted((r.ts, r.event_id, r.delay_seconds) for r in J.start_delays(pages, 10, limit).collect())
        assert [(t, d) for t, _, d in got] == exp
        # what starts late is what was deferred: the sums agree
        q = J.throttle_backlog(pages, 10, limit).orderBy("window").collect()
        assert all(r.backlog_after == max(0, r.backlog_before + r.events - limit) for r in q)
        assert max(d for _, d in exp) > 0 and q[0].backlog_before == 0
    assert J.start_delays(pages.limit(0)).count() == 0


def test_admission_takes_the_oldest(spark):
    rows = [(i, f"2024-01-{1 + (i * 7) % 28:02d} 00:00:00", 1000 - i) for i in range(60)]
    waiting = spark.createDataFrame(rows, "domain_id long, requested_at string, request_id long").repartition(5)
    for free in (-3, 0, 1, 17, 60, 100):
        got = sorted(r.request_id for r in K.admit_oldest(waiting, free).collect())
        assert got == sorted(q for _, _, q in sorted(rows, key=lambda r: (r[1], r[2]))[:max(0, free)])


def test_admission_query_leaves_no_waiting_domain_out(spark, tmp_path):
    """Seven domains wait, one has a running crawl: seven requests are admitted."""
    from sitegrove.plans.all import REGISTRY
    spark.sql("SELECT id AS c_custkey, 'X' AS c_mktsegment, CAST(id AS INT) AS c_nationkey, 1.0D AS c_acctbal FROM range(8)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("""SELECT id AS o_orderkey, id DIV 4 AS o_custkey, if(id = 20, 'O', 'F') AS o_orderstatus, '2-HIGH' AS o_orderpriority,
                 timestampadd(DAY, CAST(id AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS o_orderdate FROM range(32)""").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id AS page_id, 'https://elsewhere.example/' AS url, '' AS html FROM range(3)").write.parquet(f"{tmp_path}/pages.parquet")
    got = REGISTRY["crawl_admission"].build(spark, str(tmp_path)).collect()
    assert sorted((r.domain_id, r.request_id) for r in got) == [(d, 4 * d) for d in range(8) if d != 5]


def test_pattern_index(spark):
    rnd = random.Random(6)
    words = ["docs", "blog", "a", "api", "x/y", "étage", "page", "0", "guide-to-the-long-way-home"]
    urls = {(j, "https://s.example/" + "/".join(rnd.choice(words) for _ in range(rnd.randint(0, 5)))) for j in range(3) for _ in range(120)} | {(0, "")}
    pats = [(j, f"c{i}", i, [rnd.choice(["", "docs", "blog/api", "https://s.example/a", "é", "zz", "0/guide-to-the-long-way-homf", "guide-to-the-long-way-home/page", "/", "ge"])
                             for _ in range(rnd.randint(0, 3))]) for j in range(3) for i in range(6)]
    pats.append((2, "rest", 9, None))
    pages = spark.createDataFrame([(j, u, i) for i, (j, u) in enumerate(sorted(urls))] + [(1, None, 999)], "job_id long, url string, pos long")
    parsed = spark.createDataFrame(pats, "job_id long, category string, cat_pos int, patterns array<string>")
    exp = sorted((j, c, k, u, i) for i, (j, u) in enumerate(sorted(urls)) for jj, c, k, ps in pats if j == jj and any(p in u for p in ([""] if ps is None else ps)))
    for limit in (0, 100, 10**9):
        got = A.match_categories(pages, parsed, pair_limit=limit)
        assert sorted(tuple(r) for r in got.select("job_id", "category", "cat_pos", "url", "pos").collect()) == exp
        assert A.match_categories(pages.drop("pos"), parsed, pair_limit=limit).columns == ["job_id", "category", "cat_pos", "url"]
    counts = {r.job_id: (r.pages, r.uncategorized) for r in A.uncategorized_counts(pages.where("url IS NOT NULL"), got).collect()}
    taken = {(j, u) for j, _, _, u, _ in exp}
    assert counts == {j: (sum(x == j for x, _ in urls), sum(x == j and (x, u) not in taken for x, u in urls)) for j in range(3)}


def test_many_urls_and_patterns_never_meet_in_pairs(spark):
    """One job of 20,000 urls and 20,000 patterns: the pairs compared stay few."""
    n = 20_000
    pages = spark.range(n).select(F.lit(1).cast("long").alias("job_id"), F.format_string("https://big.example/section/item-%06d/view", "id").alias("url"))
    parsed = spark.createDataFrame([(1, "all", 0, [f"item-{i:06d}/" for i in range(0, 2 * n, 2)])], "job_id long, category string, cat_pos int, patterns array<string>")
    assert A.match_categories(pages, parsed).count() == n // 2


def test_stats_over_batches(spark):
    rnd = random.Random(9)
    rows = [(rnd.randint(1, 4), rnd.randint(1, 30), rnd.choice([None, 1, 2, 3, 4])) for _ in range(300)] + [(7, None, None)]
    df = spark.createDataFrame(rows, "job_id long, page_id long, importance int")
    path = tempfile.mkdtemp(prefix="sg-stats-", dir="/tmp")
    run = ST.stats_batches(path, fanout=3)
    for batch in (0, 1, 2, 2, 3):  # batch 2 is replayed
        run(spark.createDataFrame(rows[batch::4], df.schema), batch)
    got = {r.job_id: r for r in ST.read_stats(spark, path, exact=True).collect()}
    for job in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == job]
        scored = [i for _, _, i in own if i is not None]
        pages = {p for _, p, _ in own if p is not None}
        r = got[job]
        assert (r.total, r.changed, r.skipped) == (len(own), sum(i is None or i >= 2 for *_, i in own), sum(i == 1 for *_, i in own))
        assert r.unique_pages == len(pages) == r.approx_pages and r.average_importance == (sum(scored) / len(scored) if scored else None)


def test_sketch_is_within_its_error(spark):
    v = spark.range(60_000).select((F.col("id") % 2).alias("job_id"), (F.col("id") % 40_000).alias("page_id"), F.lit(3).alias("importance"))
    parts = ST.partial_stats(v.where("page_id < 25000")).unionByName(ST.partial_stats(v.where("page_id >= 15000")))
    for r in ST.merge_stats(parts).collect():
        assert abs(r.approx_pages - 20_000) < 20_000 * 0.03


def test_closes_over_batches(spark):
    rnd = random.Random(3)
    rows = [(job, T0 + timedelta(seconds=rnd.randint(0, 50)), rnd.choice([1, 1, 2, 2, 3])) for job in (1, 2, 3) for _ in range(40)] + [(9, T0, 1)]
    schema = "job_id long, ts timestamp_ntz, kind int"
    prior = spark.createDataFrame([(1, '{"a":1}'), (2, None)], "job_id long, stats string")
    exp = sorted(tuple(r) for r in J.close_bookkeeping(spark.createDataFrame(rows, schema), prior).collect())
    rnd.shuffle(rows)
    path = tempfile.mkdtemp(prefix="sg-close-", dir="/tmp") + "/t"
    run = ST.close_batches(path, fanout=3)
    for batch in (0, 1, 2, 2, 3):
        run(spark.createDataFrame(rows[batch::4], schema), batch)
    assert sorted(tuple(r) for r in ST.read_closes(spark, path, prior).collect()) == exp and len(exp) == 3
