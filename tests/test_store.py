"""Content store (A4-A7), near-match grouping (G12) and the foreachBatch
version pipeline (S8)."""

import glob
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from sitegrove.operators.nearmatch import near_match_groups
from sitegrove.operators.versions import process_versions
from sitegrove.sources import derived as D
from sitegrove.sources import store


def test_upsert_list_load(spark):
    root = tempfile.mkdtemp(prefix="sg-store-", dir="/tmp") + "/content"
    a = spark.createDataFrame([("domains/a_com/jobs/jan_1_2024_00_00_1/pages/x_raw.md", "one"),
                               ("domains/a_com/jobs/jan_1_2024_00_00_1/pages/y_raw.md", "two"),
                               ("domains/b_com/jobs/jan_2_2024_00_00_2/pages/z_raw.md", "three")], "path string, content string")
    store.upsert_content(spark, a, root)
    b = spark.createDataFrame([("domains/a_com/jobs/jan_1_2024_00_00_1/pages/x_raw.md", x) for x in ("ONE", "OLDER")],
                              "path string, content string")  # a path twice in one write is one object
    store.upsert_content(spark, b, root)
    got = {r.path: r.content for r in store.read_content(spark, root).collect()}
    assert got["domains/a_com/jobs/jan_1_2024_00_00_1/pages/x_raw.md"] == "ONE"
    assert len(got) == 3
    listed = [r.path for r in store.list_content(spark, root, "domains/a_com/jobs/jan_1_2024_00_00_1/pages",
                                                 limit=1, offset=1).collect()]
    assert listed == ["domains/a_com/jobs/jan_1_2024_00_00_1/pages/y_raw.md"]
    v = spark.createDataFrame([(1, "domains/a_com/jobs/jan_1_2024_00_00_1/pages/y_raw.md"), (2, "missing")],
                              "id int, p string")
    loaded = {r.id: r.content for r in store.load_content(v, store.read_content(spark, root), "p").collect()}
    assert loaded == {1: "two", 2: ""}
    store.delete_content(spark, b.select("path"), root)
    assert sorted(r.content for r in store.read_content(spark, root).collect()) == ["three", "two"]


def test_append_is_replay_safe(spark):
    root = tempfile.mkdtemp(prefix="sg-append-", dir="/tmp") + "/versions"
    a, b = (spark.createDataFrame([(i, "v")], "id long, t string") for i in (1, 2))
    for df, batch in ((a, "b1"), (b, "b2"), (b, "b2")):
        store.append_versions(df, root, batch)
    assert sorted(r.id for r in spark.read.parquet(root).collect()) == [1, 2]


def test_write_documents(spark):
    root = tempfile.mkdtemp(prefix="sg-docs-", dir="/tmp") + "/docs"
    d = spark.createDataFrame([("domains/a_com/jobs/f1/llms.txt", "llms_txt", "# a\nbody"),
                               ("domains/a_com/jobs/f1/llms-full.txt", "llms_full_txt", None)],
                              "path string, kind string, content string")
    store.write_documents(d, root)
    files = [f for f in glob.glob(root + "/**/*.txt", recursive=True) if os.path.getsize(f) > 0]
    assert len(files) == 1 and "kind=llms_txt" in files[0]
    assert open(files[0]).read() == "# a\nbody\n"
    assert [tuple(r) for r in store.read_documents(spark, root).collect()] == [("a_com", "f1", "llms_txt", "# a\nbody")]


def test_near_match_groups(spark):
    base = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, base), (2, base), (3, base + " extra"),
                                  (4, " ".join(f"other{i}" for i in range(60)))], "id long, t string")
    g = {r.id: r.group_id for r in near_match_groups(docs, "id", "t").collect()}
    assert g[1] == g[2] == 1 and g[3] == 1 and g[4] == 4


def test_near_match_chain_is_one_group(spark):
    """Texts that each resemble the next one only: one group, and every member is
    similar to another one; a shared band alone makes no group."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[i * 6:i * 6 + 100])) for i in range(8)] + [(90, "w1 w2 w3 alone"), (91, None), (92, None)]
    g = {r.id: r.group_id for r in near_match_groups(spark.createDataFrame(docs, "id long, t string"), "id", "t", bands=32, rows=2).collect()}
    assert [g[i] for i in range(8)] == [0] * 8 and g[90] == 90 and g[91] == g[92] == 91


def test_near_match_in_bands_with_a_dissimilar_least_id(spark):
    """Texts 1 and 2 of a family are similar, text 0 shares most of their bands
    but is below the threshold of both."""
    docs = []
    for f in range(10):
        w = [f"f{f}w{i}" for i in range(70)]
        docs += [(10 * f, " ".join(w[:40] + w[60:])), (10 * f + 1, " ".join(w[:50])), (10 * f + 2, " ".join(w[:49] + w[50:51]))]
    df = spark.createDataFrame(docs, "id long, t string")
    for members in (1024, 2):
        g = {r.id: r.group_id for r in near_match_groups(df, "id", "t", bands=4, rows=1, block_members=members).collect()}
        assert g == {10 * f + i: 10 * f + min(i, 1) for f in range(10) for i in range(3)}


def test_foreach_batch_versions_match_batch(spark, sf_small):
    from sitegrove.streaming.crawl_stream import checkpoint_path, read_versions, version_batches
    chain = D.version_chain(spark, sf_small)
    src = tempfile.mkdtemp(prefix="sg-chain-", dir="/tmp")
    # one file per crawl round, arriving in order
    chain.repartition("seq").write.mode("overwrite").partitionBy("seq").json(src)
    table = tempfile.mkdtemp(prefix="sg-versions-", dir="/tmp") + "/versions"
    stream = (spark.readStream.schema("id long, page_id long, text string, seq long")
              .option("maxFilesPerTrigger", 1).json(src))
    q = (stream.writeStream.foreachBatch(version_batches(table))
         .option("checkpointLocation", checkpoint_path(spark, os.path.basename(table) + str(os.getpid())))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = read_versions(spark, table).select("id", "prev_id", "importance", "has_changes")
    exp = process_versions(chain).select("id", "prev_id", "importance", "has_changes")
    assert got.count() == exp.count()
    assert got.exceptAll(exp).count() == 0


def _versions(spark, table):
    from sitegrove.streaming.crawl_stream import read_versions
    cols = ["id", "page_id", "seq", "prev_id", "prev_enhanced", "stored_md", "additions", "deletions", "importance", "reason", "title"]
    return sorted(tuple(r) for r in read_versions(spark, table).select(*cols).collect())


def test_foreach_batch_replay_is_idempotent(spark, sf_small):
    """A micro-batch run twice (executor or driver failure before the commit)
    leaves the same version table."""
    from sitegrove.streaming.crawl_stream import version_batches
    chain = D.version_chain(spark, sf_small).select("id", "page_id", "text", "seq")
    table = tempfile.mkdtemp(prefix="sg-replay-", dir="/tmp") + "/versions"
    run = version_batches(table)
    run(chain.filter("seq = 0"), 0)
    run(chain.filter("seq = 1"), 1)
    first = _versions(spark, table)
    run(chain.filter("seq = 1"), 1)          # replay of the last batch
    assert _versions(spark, table) == first and any(r[3] is not None for r in first)


def test_late_version_takes_its_place(spark):
    from sitegrove.streaming.crawl_stream import version_batches
    table = tempfile.mkdtemp(prefix="sg-late-", dir="/tmp") + "/versions"
    run = version_batches(table)
    for batch, (seq, id_) in enumerate([(0, 10), (5, 15), (3, 13), (6, 16), (1, 11)]):
        run(spark.createDataFrame([(id_, 1, f"# T\ntext {seq}\nend", seq)], "id long, page_id long, text string, seq long"), batch)
    assert [(r[0], r[3]) for r in _versions(spark, table)] == [(10, None), (11, 10), (13, 11), (15, 13), (16, 15)]


@pytest.mark.parametrize("against", ["cleaned", "stored"])
def test_any_order_of_arrival_equals_the_batch(spark, against):
    """Versions in random order over several micro-batches, some sent again, one
    of them with another text: the table is the batch pipeline's."""
    from sitegrove.operators.stored import stored_versions
    from sitegrove.streaming.crawl_stream import version_batches
    rnd = random.Random(11)
    texts = ["# A\none\ntwo", "# A\none\nthree", "# B\none\ntwo\nthree", "# A\none\nTWO\nthree\nfour"]
    rows = []
    for page in range(7):
        t = rnd.choice(texts)
        for seq in range(rnd.choice([1, 4, 9])):
            t = t if rnd.random() < 0.6 else rnd.choice(texts)
            rows.append((len(rows), page, seq, t))
    schema = "id long, page_id long, seq long, text string"
    scores = spark.createDataFrame([(i, str(rnd.choice([1, 2, 4]))) for i in range(len(rows))], "id long, response string")
    sent = rows + [rows[3]] + [(*rows[8][:3], "# Corrected\nx\ny")]
    late = rnd.sample(sent[:-1], len(sent) - 1) + [sent[-1]]
    table = tempfile.mkdtemp(prefix="sg-order-", dir="/tmp") + "/versions"
    run = version_batches(table, against=against, scores=scores, extract_main=False, fanout=3, buckets=4)
    cuts = [0, 5, 6, 17, len(late) - 1, len(late)]
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:])):
        run(spark.createDataFrame(late[a:b], schema), batch)
    final = spark.createDataFrame(rows[:8] + [sent[-1]] + rows[9:], schema)
    if against == "cleaned":
        exp = process_versions(final, scores=scores, extract_main=False).withColumn("prev_enhanced", F.lit(False))
    else:
        exp = stored_versions(final, scores=scores, extract_main=False)
    cols = ["id", "page_id", "seq", "prev_id", "prev_enhanced", "stored_md", "additions", "deletions", "importance", "reason", "title"]
    assert _versions(spark, table) == sorted(tuple(r) for r in exp.select(*cols).collect())


def test_webhook_log_batch_roundtrip(spark, sf_small):
    """A1: the webhook log written as JSON lines and read back with the fixed
    schema parses to the same routing as the in-memory log."""
    from sitegrove.sources import events as E
    path = tempfile.mkdtemp(prefix="sg-wlog-", dir="/tmp") + "/log"
    log = E.webhook_payloads(D.crawl_events(spark, sf_small))
    E.write_webhook_log(log, path)
    a = E.parse_webhooks(E.read_webhook_log(spark, path)).drop("data")
    b = E.parse_webhooks(log).drop("data")
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
