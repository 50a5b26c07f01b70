"""Batch-equals-stream checks for the crawl-event jobs (S1-S4, S8), run with an
availableNow trigger over the webhook log written as several files."""

import tempfile
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitegrove.operators import jobstate as J
from sitegrove.plans.q_events import event_pipeline
from sitegrove.sources import derived as D
from sitegrove.sources import events as E
from sitegrove.streaming import crawl_stream as CS


def _write_log(spark, sf, n_files=6, shuffled=False):
    """The log as files of consecutive time slices, as a webhook receiver would
    write them; or shuffled within what the watermark allows, with some
    deliveries twice. A last event, hours later, moves the watermark past all."""
    d = tempfile.mkdtemp(prefix="sg-log-", dir="/tmp")
    log = E.webhook_payloads(D.crawl_events(spark, sf))
    end = log.agg(F.max("ts")).first()[0]
    late = log.limit(1).select((-F.lit(1)).cast("long").alias("event_id"),
                               (F.lit(end).cast("timestamp_ntz") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit("{}").alias("payload"))
    if shuffled:
        parts = [log.unionByName(log.filter("event_id % 5 = 0")).repartition(n_files, F.hash("event_id"))]
    else:
        slot = log.withColumn("_f", F.ntile(n_files).over(Window.orderBy("ts"))).persist()
        parts = [slot.filter(F.col("_f") == i + 1).drop("_f").coalesce(1) for i in range(n_files)]
    for part in [*parts, late]:  # files are read in the order of their times
        part.write.mode("append").option("timestampNTZFormat", E.LOG_TS_FORMAT).json(d)
        time.sleep(0.2)
    return d


def _run(query_df, spark, name, mode="append"):
    table = f"t_{name}"
    q = (query_df.writeStream.format("memory").queryName(table).outputMode(mode)
         .option("checkpointLocation", CS.checkpoint_path(spark, name + tempfile.mktemp(dir="").strip("/")))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(table)


def test_stream_matches_batch(spark, sf_small):
    path = _write_log(spark, sf_small)
    jobs = D.jobs(spark, sf_small)
    parsed = CS.parsed_stream(CS.read_webhook_log(spark, path, max_files_per_trigger=2))
    pages = CS.page_stream(parsed, jobs)
    closes = CS.close_stream(parsed, jobs)
    events = CS.job_events(pages, closes)

    batch = event_pipeline(spark, sf_small)
    # Same deduplicated (job, url, scrape_id) keys
    got = _run(pages.select("job_id", "url", "scrape_id"), spark, "pages")
    exp = batch["pages"].select("job_id", "url", "scrape_id")
    assert got.count() == exp.count()
    assert got.exceptAll(exp).count() == 0

    # Progress counters
    prog = _run(CS.progress_stream(events), spark, "progress", mode="complete")
    bprog = J.job_progress(batch["events"]).select(
        "job_id", "pages_received", "pages_processed", "stream_closed")
    assert prog.exceptAll(bprog).count() == 0 and bprog.exceptAll(prog).count() == 0

    # S3: exactly one ready trigger per job, for the same jobs as the batch form
    ready = _run(CS.ready_stream(events), spark, "ready")
    r = ready.filter(F.col("event") == "ready")
    assert r.groupBy("job_id").count().filter("count > 1").count() == 0
    bready = J.ready_triggers(batch["events"])
    assert _ready(r) == _ready(bready, "ready_at")


def _ready(df, ts="ts"):
    return sorted((x.job_id, x.ts, x.completed_pages) for x in
                  df.select("job_id", F.col(ts).cast("string").alias("ts"), "completed_pages").collect())


def test_ready_does_not_depend_on_arrival(spark, sf_small):
    """Shuffled files, deliveries that repeat, and a restart from the checkpoint
    give the batch's triggers with their times and page counts."""
    jobs = D.jobs(spark, sf_small)
    path = _write_log(spark, sf_small, shuffled=True)
    check = CS.checkpoint_path(spark, "shuffled" + tempfile.mktemp(dir="").strip("/"))
    out = tempfile.mkdtemp(prefix="sg-ready-", dir="/tmp") + "/out"

    def run(limit):
        parsed = CS.parsed_stream(CS.read_webhook_log(spark, path, max_files_per_trigger=2), watermark="300 days")
        events = CS.job_events(CS.page_stream(parsed, jobs), CS.close_stream(parsed, jobs))
        w = (CS.ready_stream(events, stall_timeout_ms=3_600_000).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", check).outputMode("append"))
        q = w.trigger(processingTime="0 seconds").start() if limit else w.trigger(availableNow=True).start()
        if limit:  # stop after the first batches
            while q.lastProgress is None and q.isActive:
                time.sleep(0.2)
            q.stop()
        else:
            q.awaitTermination()
    run(True)
    run(False)
    got = spark.read.parquet(out)
    exp = J.ready_triggers(event_pipeline(spark, sf_small)["events"])
    assert _ready(got.filter("event = 'ready'")) == _ready(exp, "ready_at") != []


class _State:
    """What ``applyInPandasWithState`` hands to the function."""

    def __init__(self):
        self.value, self.now, self.timer, self.hasTimedOut = None, 0, None, False
        self.exists = False

    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, value):
        self.value, self.exists, self.timer = value, True, None

    def setTimeoutTimestamp(self, ms):
        assert ms > self.now
        self.timer = ms


def test_counts_survive_a_stall():
    import pandas as pd
    fn, state = CS._ready_fn(1000), _State()

    def call(now, rows):
        state.now, state.hasTimedOut = now, rows is None
        frames = [] if rows is None else [pd.DataFrame({"event_ts": pd.to_datetime([r[0] for r in rows], unit="ms"), "kind": [r[1] for r in rows]})]
        return [tuple(x) for f in fn((7,), iter(frames), state) for x in f[["event", "completed_pages"]].itertuples(index=False)]
    assert call(0, [(10, 1), (20, 1), (15, 2)]) == [] and state.timer == 11
    assert call(100, None) == [] and state.timer == 1020
    assert call(1020, None) == [("stalled", 1)]
    assert call(1020, [(5000, 3), (4000, 2)]) == []
    assert call(6000, None) == [("ready", 2)]
    assert call(9000, [(9500, 1)]) == [] and call(20_000, None) == []


def test_rate_stream_matches_batch(spark, sf_small):
    path = _write_log(spark, sf_small, n_files=3)
    jobs = D.jobs(spark, sf_small)
    parsed = CS.parsed_stream(CS.read_webhook_log(spark, path, max_files_per_trigger=1))
    pages = CS.page_stream(parsed, jobs)
    got = _run(CS.rate_stream(pages), spark, "rate")
    batch = J.rate_windows(event_pipeline(spark, sf_small)["pages"]).select("window_start", "events", "over_limit")
    got = got.withColumn("window_start", F.col("window_start").cast("string"))
    batch = batch.withColumn("window_start", F.col("window_start").cast("string"))
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0
