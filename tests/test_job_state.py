"""The keyed job-state processor against the batch forms, and on a small history."""

import tempfile
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitegrove.operators import jobstate as J
from sitegrove.plans.q_events import event_pipeline
from sitegrove.streaming import crawl_stream as CS
from sitegrove.streaming import job_state as JS

from test_streaming import _ready, _run, _write_log

KEY = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(KEY, None)
    spark.conf.set(KEY, JS.STATE_STORE)
    yield spark
    spark.conf.set(KEY, before) if before else spark.conf.unset(KEY)


def test_stream_equals_the_batch(rocks, sf_small):
    spark = rocks
    path = _write_log(spark, sf_small, shuffled=True)
    batch = event_pipeline(spark, sf_small)
    jobs = batch["jobs"]
    parsed = CS.parsed_stream(CS.read_webhook_log(spark, path, max_files_per_trigger=2), watermark="300 days")
    closes = CS.close_stream(parsed, jobs)
    events = CS.job_events(CS.page_stream(parsed, jobs), closes)

    def ended(c):
        return c.select("job_id", "ts", F.lit("finished").alias("status"), F.lit('{"streamClosed":true}').alias("stats"), F.lit(True).alias("merge"))
    got = _run(JS.job_state_stream(JS.with_terminal(events, ended(closes)), jobs), spark, "jobstate").persist()
    assert _ready(got.filter("event = 'ready'")) == _ready(J.ready_triggers(batch["events"]), "ready_at") != []
    # the terminal rows fold the stored jobs as the batch's do; ended jobs absorbed theirs
    rows = got.filter("event = 'ended'").select("job_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "status", "stats", "merge")
    exp = J.fold_job_state(jobs, ended(batch["closes"]))
    folded = J.fold_job_state(jobs, rows)
    assert folded.exceptAll(exp).count() == 0 and exp.exceptAll(folded).count() == 0
    assert rows.count() > 0 and rows.join(jobs.filter("status <> 'processing'"), rows.job_id == jobs.id).count() == 0
    # jobs with events that never became ready stalled once the log went quiet
    quiet = {r.job_id for r in got.filter("event = 'stalled'").collect()}
    seen = {r.job_id for r in batch["events"].select("job_id").distinct().collect()}
    assert quiet >= seen - {r.job_id for r in got.filter("event = 'ready'").collect()}
    got.unpersist()


def test_a_history_in_four_batches(rocks):
    spark = rocks
    t0 = datetime(2024, 1, 1)
    d = tempfile.mkdtemp(prefix="sg-js-", dir="/tmp")
    schema = "job_id long, ts timestamp, event_ts timestamp, kind int, status string, stats string, merge boolean"

    def put(rows):
        out = [(j, t0 + timedelta(seconds=s), t0 + timedelta(seconds=s), k, *(e or (None, None, None))) for j, s, k, e in rows]
        spark.createDataFrame(out, schema).coalesce(1).write.mode("append").json(d)
        time.sleep(0.2)  # files are read in the order of their times
    # job 1: a close before its last page; job 2: stalls, then goes on; job 3 ended before;
    # job 4: canceled, a later failure is absorbed though it comes first
    put([(1, 30, 3, None), (1, 10, 1, None), (1, 20, 1, None), (2, 5, 1, None), (3, 8, 4, ("failed", "{}", False)), (4, 60, 4, ("failed", "{}", False))])
    put([(1, 25, 2, None), (1, 40, 2, None), (4, 50, 4, ("canceled", '{"a":1}', False)), (2, 6, 2, None)])
    put([(9, 8000, 1, None)])
    put([(9, 8100, 1, None)])
    put([(2, 9000, 3, None), (9, 20_000, 3, None), (9, 40_000, 3, None)])
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(d).withWatermark("ts", "100 seconds")
    jobs = spark.createDataFrame([(1, "processing"), (2, "processing"), (3, "finished"), (4, "processing")], "id long, status string")
    got = _run(JS.job_state_stream(s, jobs, stall_timeout_ms=1_000_000), spark, "jshistory").collect()
    life = {}
    for r in sorted(got, key=lambda r: r.ts):
        life.setdefault(r.job_id, []).append((r.event, (r.ts - t0).total_seconds(), r.completed_pages, r.status))
    assert life[1] == [("ready", 40.0, 2, None)]
    assert life[2] == [("stalled", 6.0, 1, None), ("ready", 9000.0, 1, None)]
    assert 3 not in life
    assert [x for x in life[4] if x[0] == "ended"] == [("ended", 50.0, 0, "canceled")]
