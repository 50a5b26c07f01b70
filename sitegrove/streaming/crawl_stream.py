"""Structured Streaming jobs over the crawl webhook log.

Source: JSON-lines webhook log files (event_id, ts, payload) read with
``readStream`` and a fixed schema; intake per trigger is bounded with
``maxFilesPerTrigger`` (the reference's 100-per-10-s throttle becomes a
back-pressure setting, S4 reports the windowed rate).

* ``page_stream``      A1 parse -> A2 explode -> A3 stream-static job lookup
                       -> S5 only 'processing' jobs -> S1 dedupe within the
                       watermark on (job, url, scrapeId).
* ``progress_stream``  S2: received / processed / closed per job (update mode).
* ``ready_stream``     S3 + S7: ``applyInPandasWithState`` keyed by job; events
                       wait in the state until the watermark has passed them and
                       are then counted in event-time order, so the trigger does
                       not depend on the order of arrival; exactly one per job.
                       Jobs that go quiet before are reported as stalled and
                       keep their counts.
* ``rate_stream``      S4: 10-second tumbling windows, append mode.
* ``version_batches``  S8: ``foreachBatch`` of the version pipeline, with late
                       versions (``version_stream``).

Checkpoints live under the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import jobstate as J
from ..session import ensure_checkpoint_dir
from ..sources import events as E
from .version_stream import read_versions, version_batches  # noqa: F401

# event time must be a TIMESTAMP for watermarks; the session zone is UTC, so
# the wall-clock values equal the batch tables' TIMESTAMP_NTZ values
LOG_SCHEMA = "event_id long, ts timestamp, payload string"


def checkpoint_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def read_webhook_log(spark: SparkSession, path: str, max_files_per_trigger: int = 10) -> DataFrame:
    from ..sources.events import LOG_TS_FORMAT
    return (spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .option("timestampFormat", LOG_TS_FORMAT).json(path))


def parsed_stream(log: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """A1 over the stream; the event-time watermark is set once, here, on the
    delivery time, and every stateful step downstream uses it."""
    return E.parse_webhooks(log.withWatermark("ts", watermark))


def page_stream(parsed: DataFrame, jobs: DataFrame) -> DataFrame:
    """Accepted, job-resolved, deduplicated page documents."""
    docs = E.explode_pages(parsed)
    matched, _ = J.lookup_jobs(docs, jobs)
    pages = J.accept_for_job(matched).select("job_id", "url", "scrape_id", "ts", "event_id", "doc_pos", "domain_id")
    return pages.dropDuplicatesWithinWatermark(["job_id", "url", "scrape_id"])


def close_stream(parsed: DataFrame, jobs: DataFrame) -> DataFrame:
    comp = parsed.filter((F.col("status") == "accepted") & (F.col("type") == "crawl.completed"))
    closes, _ = J.lookup_jobs(comp, jobs)
    return closes.select("job_id", "ts")


def job_events(pages: DataFrame, closes: DataFrame) -> DataFrame:
    """(job_id, ts, event_ts, kind) with kind 1 = page received, 2 = page
    processed, 3 = stream closed; ``ts`` is the (watermarked) delivery time,
    ``event_ts`` when the step happened. Processed events follow the batch
    rule (ts + event_id % 7 s, never when event_id % 10 = 9)."""
    recv = F.struct(F.col("ts").alias("event_ts"), F.lit(1).alias("kind"))
    proc = F.struct(F.expr("timestampadd(SECOND, CAST(event_id % 7 AS INT), ts)").alias("event_ts"),
                    F.lit(2).alias("kind"))
    both = F.when(F.col("event_id") % 10 != 9, F.array(recv, proc)).otherwise(F.array(recv))
    p = pages.select("job_id", "ts", F.explode(both).alias("e")).select("job_id", "ts", "e.event_ts", "e.kind")
    c = closes.select("job_id", "ts", F.col("ts").alias("event_ts"), F.lit(3).alias("kind"))
    return p.unionByName(c)


def progress_stream(events: DataFrame) -> DataFrame:
    """S2/D6 as a streaming aggregate (update or complete mode)."""
    return events.groupBy("job_id").agg(
        F.count_if(F.col("kind") == 1).alias("pages_received"),
        F.count_if(F.col("kind") == 2).alias("pages_processed"),
        (F.count_if(F.col("kind") == 3) > 0).alias("stream_closed"))


READY_OUT = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("event", T.StringType()),
                          T.StructField("ts", T.TimestampType()),
                          T.StructField("completed_pages", T.LongType())])
READY_STATE = T.StructType([T.StructField("rec", T.LongType()), T.StructField("proc", T.LongType()),
                            T.StructField("closed", T.BooleanType()), T.StructField("emitted", T.BooleanType()),
                            T.StructField("stalled", T.BooleanType()), T.StructField("last_ms", T.LongType()),
                            T.StructField("waiting", T.BinaryType())])


def _ready_fn(timeout_ms: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rec, proc, closed, emitted, stalled, last_ms, waiting = state.get if state.exists else (0, 0, False, False, False, 0, b"")
        # rows (event time in microseconds, kind): those that waited, and the new ones
        held = [np.frombuffer(bytes(waiting), np.int64).reshape(-1, 2)]
        for p in [] if state.hasTimedOut else pdfs:
            us = p["event_ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            held.append(np.column_stack([us, p["kind"].to_numpy(np.int64)]))
            stalled = False
        ev = np.concatenate(held)
        ev = ev[np.lexsort((ev[:, 1], ev[:, 0]))]
        now = state.getCurrentWatermarkMs()
        final, ev = ev[ev[:, 0] <= now * 1000], ev[ev[:, 0] > now * 1000]
        out = []
        if len(final):
            us, kind = final[:, 0], final[:, 1]
            recs, procs = rec + np.cumsum(kind == 1), proc + np.cumsum(kind == 2)
            shut = closed | (np.cumsum(kind == 3) > 0)
            hit = np.flatnonzero((kind >= 2) & shut & (recs == procs) & (procs > 0))
            if len(hit) and not emitted:
                emitted = True
                out.append((int(key[0]), "ready", pd.Timestamp(int(us[hit[0]]), unit="us"), int(procs[hit[0]])))
            rec, proc, closed, last_ms = int(recs[-1]), int(procs[-1]), bool(shut[-1]), int(max(last_ms, us[-1] // 1000))
        if not len(ev) and not emitted and not stalled and last_ms + timeout_ms <= now:
            stalled = True
            out.append((int(key[0]), "stalled", pd.Timestamp(last_ms, unit="ms"), proc))
        state.update((rec, proc, closed, emitted, stalled, last_ms, ev.astype(np.int64).tobytes()))
        if len(ev):
            state.setTimeoutTimestamp(int(ev[0, 0] // 1000) + 1)
        elif not emitted and not stalled:
            state.setTimeoutTimestamp(max(last_ms + timeout_ms, now + 1))
        if out:
            yield pd.DataFrame(out, columns=["job_id", "event", "ts", "completed_pages"])
    return fn


def ready_stream(events: DataFrame, watermark: str | None = None, stall_timeout_ms: int = 3_600_000) -> DataFrame:
    """S3 (+S7): one 'ready' row per job at the first event, in event-time order,
    after which it is closed, all received pages are processed and at least one
    page was; it comes out once the watermark has passed that event. A 'stalled'
    row when a job goes quiet for ``stall_timeout_ms`` of event time without
    becoming ready; its counts stay, so it can still become ready.
    The event-time timeout uses the query's watermark: the one set by
    ``page_stream``, or ``watermark`` when the input has none yet."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    return (events.groupBy("job_id")
                  .applyInPandasWithState(_ready_fn(stall_timeout_ms), READY_OUT, READY_STATE, "append",
                                          GroupStateTimeout.EventTimeTimeout))


def rate_stream(pages: DataFrame, seconds: int = 10, limit: int = 100) -> DataFrame:
    """Windowed page intake, emitted once the window is complete."""
    w = F.window("ts", f"{seconds} seconds")
    return (pages.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("events"))
                 .select(F.col("w.start").alias("window_start"), "events",
                         (F.col("events") > limit).alias("over_limit")))
