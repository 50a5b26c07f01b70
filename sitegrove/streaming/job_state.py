"""Job state as one keyed stream processor (S3, S7, M4): ready triggers, stalls and
terminal states with ``transformWithStateInPandas``.

Events wait in a map state under their time and kind, as counts, until the
watermark has passed them, and are then folded in event-time order: results don't
depend on the order of arrival. A timer stands at the first waiting event or, when
none waits, at the end of the quiet period. The stored job table is the initial
state: a job that has ended absorbs what comes later, as the first terminal event
does. Nothing of a job's history is kept beyond its counts.

The state store must be RocksDB:
``spark.sql.streaming.stateStore.providerClass`` = ``STATE_STORE``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "job_id long, event string, ts timestamp, completed_pages long, status string, stats string, merge boolean"
RECEIVED, PROCESSED, CLOSED, TERMINAL = 1, 2, 3, 4


class JobState(StatefulProcessor):
    def __init__(self, stall_timeout_ms: int):
        self.timeout = stall_timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "rec long, proc long, closed boolean, emitted boolean, stalled boolean, last_ms long")
        self.waiting = handle.getMapState("waiting", "us long, kind int", "n long")
        self.endings = handle.getMapState("endings", "us long, status string, stats string, merge boolean", "n long")
        self.ended = handle.getValueState("ended", "status string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        status = initialState["status"].iloc[0]
        if status != "processing":
            self.ended.update((status,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rec, proc, closed, emitted, _, last_ms = self.counts.get() or (0, 0, False, False, False, 0)
        self.counts.update((rec, proc, closed, emitted, False, last_ms))
        for p in rows:
            us = p["event_ts"].to_numpy().astype("datetime64[us]").astype("int64")
            own = p[p["kind"] != TERMINAL]
            for (t, kind), n in own.groupby([us[(p["kind"] != TERMINAL).to_numpy()], own["kind"]]).size().items():
                at = (int(t), int(kind))
                self.waiting.updateValue(at, ((self.waiting.getValue(at)[0] if self.waiting.containsKey(at) else 0) + int(n),))
            for t, kind, status, stats, merge in zip(us, p["kind"], p["status"], p["stats"], p["merge"]):
                if kind == TERMINAL:
                    self.endings.updateValue((int(t), status, stats, bool(merge)), (1,))
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues)

    def _advance(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """Folds what the watermark has passed and sets the next timer."""
        now = timerValues.getCurrentWatermarkInMs()
        rec, proc, closed, emitted, stalled, last_ms = self.counts.get() or (0, 0, False, False, False, 0)
        out = []
        events = sorted((k, n[0]) for k, n in self.waiting.iterator())
        final = [e for e in events if e[0][0] <= now * 1000]
        for (us, kind), n in final:
            hit = None
            if kind == RECEIVED:
                rec += n
            elif kind == PROCESSED:
                hit = rec if closed and proc < rec <= proc + n else None
                proc += n
            else:
                closed = True
                hit = proc if rec == proc > 0 else None
            if hit is not None and not emitted:
                emitted = True
                out.append((int(key[0]), "ready", pd.Timestamp(us, unit="us"), hit, None, None, None))
            last_ms = max(last_ms, us // 1000)
            self.waiting.removeKey((us, kind))
        ends = sorted(k for k, _ in self.endings.iterator())
        over = [k for k in ends if k[0] <= now * 1000]
        if over and not self.ended.exists():
            us, status, stats, merge = over[0]
            self.ended.update((status,))
            out.append((int(key[0]), "ended", pd.Timestamp(us, unit="us"), proc, status, stats, merge))
        for k in over:
            self.endings.removeKey(k)
        left = [k[0] for k, _ in events[len(final):]] + [k[0] for k in ends[len(over):]]
        if not left and last_ms and not emitted and not stalled and last_ms + self.timeout <= now:
            stalled = True
            out.append((int(key[0]), "stalled", pd.Timestamp(last_ms, unit="ms"), proc, None, None, None))
        self.counts.update((rec, proc, closed, emitted, stalled, last_ms))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if left:
            self.handle.registerTimer(min(left) // 1000 + 1)
        elif last_ms and not emitted and not stalled:
            self.handle.registerTimer(max(last_ms + self.timeout, now + 1))
        if out:
            yield pd.DataFrame(out, columns=["job_id", "event", "ts", "completed_pages", "status", "stats", "merge"])

    def close(self) -> None:
        pass


def with_terminal(events: DataFrame, terminal: DataFrame) -> DataFrame:
    """The processor's input: page and close events (job_id, ts, event_ts, kind) and
    terminal ones (job_id, ts, status, stats, merge)."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("status", "string"), ("stats", "string"), ("merge", "boolean"))]
    e = events.select("job_id", "ts", "event_ts", F.col("kind").cast("int").alias("kind"), *none)
    return e.unionByName(terminal.select("job_id", "ts", F.col("ts").alias("event_ts"), F.lit(TERMINAL).alias("kind"), "status", "stats", "merge"))


def job_state_stream(events: DataFrame, jobs: DataFrame, stall_timeout_ms: int = 3_600_000) -> DataFrame:
    """Rows of one job's life: ``ready`` at most once, ``stalled`` after each quiet
    period before that, ``ended`` with the first terminal state. ``events``:
    ``with_terminal`` of watermarked streams; ``jobs``: the stored (id, status)."""
    stored = jobs.select(F.col("id").alias("job_id"), "status").groupBy("job_id")
    return events.groupBy("job_id").transformWithStateInPandas(JobState(stall_timeout_ms), OUT, "append", "EventTime", initialState=stored)
