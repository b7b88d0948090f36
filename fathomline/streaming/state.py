"""Stateful streams on ``transformWithState``: state that goes when it has no more say, and jobs moved on by timers.

Time is event time: timers fire when the watermark passes them, so a stream run over a table's files gives what the batch twin gives.
State is kept by RocksDB (``use_rocksdb`` sets the session's provider), which holds it on disk and in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from fathomline.streaming import ingest

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that are started from now on keep their state in RocksDB, unless the user has chosen another provider."""
    if not spark._jsparkSession.sessionState().conf().contains(PROVIDER):
        spark.conf.set(PROVIDER, ROCKSDB)


def milliseconds(t: pd.Timestamp) -> int:
    return t.value // 1_000_000


def timer_at(handle, when: int | None) -> None:
    """One timer for the key, in place of those it has."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    if when is not None:
        handle.registerTimer(when)


class Expiring(StatefulProcessor):
    """Accepts events by a step of ``ingest``; a key's state goes once ``span`` seconds have passed since its last time."""

    def __init__(self, kind: str, time: str, span: float, names: list[str], options: dict):
        self.kind, self.time, self.span, self.names, self.options = kind, time, span, names, options

    def init(self, handle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        have = list(self.times.get()[0]) if self.times.exists() else []
        kept, have = ingest._accepted(pd.concat(list(rows), ignore_index=True), have, self.kind, self.time, self.options)
        self.times.update((have,))
        # rounded up: state may outlive its say by a millisecond, never the other way
        timer_at(self.handle, int((max(have) + self.span) * 1000) + 1 if have else None)
        yield kept[self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield pd.DataFrame(columns=self.names)

    def close(self) -> None:
        pass


def expiring_stream(events: DataFrame, keys: list[str], kind: str, time: str = "ts", late: str = "0 seconds", **options) -> DataFrame:
    """The accepted events of a stream. Events later than the watermark (``late`` behind the newest) are dropped.

    A key's events of one trigger are held together, to be put in order: bound the trigger (``maxFilesPerTrigger``).
    """
    use_rocksdb(events.sparkSession)
    span = float(options.get("ttl", options.get("seconds", {"dedup": ingest.DEDUP_TTL, "rate": ingest.RATE_WINDOW, "throttle": ingest.THROTTLE}[kind])))
    processor = Expiring(kind, time, span, events.columns, options)
    return events.withWatermark(time, late).groupBy(*keys).transformWithStateInPandas(processor, events.schema, "Append", "EventTime")


JOB = "status string, attempts long, delay_until long, lock_until long, timeout_at long"
MOVED = "id long, status string, attempts long, at timestamp"


class JobTimers(StatefulProcessor):
    """Holds a job from an update to its next timer; a job that waits, or has ended, leaves no state."""

    def __init__(self, most_attempts: int):
        self.most_attempts = most_attempts

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable").iloc[-1]
        times = {c: None if pd.isna(last[c]) else milliseconds(pd.Timestamp(last[c])) for c in ("delay_until", "lock_until", "timeout_at")}
        wanted = {"delayed": ("delay_until",), "active": ("lock_until", "timeout_at")}.get(last["status"], ())
        due = [times[c] for c in wanted if times[c] is not None]
        if due:
            self.job.update((last["status"], int(last["attempts"]), times["delay_until"], times["lock_until"], times["timeout_at"]))
            # a timer that is already due fires with the next watermark
            timer_at(self.handle, min(due) + (last["status"] == "active"))
        else:
            self.job.clear()
            timer_at(self.handle, None)
        yield pd.DataFrame({"id": [], "status": [], "attempts": [], "at": pd.to_datetime([])}).astype({"id": "int64", "attempts": "int64", "status": "object"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, _, lock, timeout = self.job.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if status == "delayed":
            moved = ("waiting", attempts)
        elif timeout is not None and timeout < now:
            moved = ("failed", attempts)
        else:
            moved = ("dead" if attempts + 1 >= self.most_attempts else "waiting", attempts + 1)
        self.job.clear()
        yield pd.DataFrame({"id": [int(key[0])], "status": [moved[0]], "attempts": [moved[1]], "at": [pd.Timestamp(now - (status == "active"), unit="ms")]})

    def close(self) -> None:
        pass


def job_timers(updates: DataFrame, most_attempts: int = 3, late: str = "0 seconds") -> DataFrame:
    """(id, status, attempts, at) of each job that a timer moves on: promoted, timed out, requeued or given up.

    ``updates`` (id, status, attempts, delay_until, lock_until, timeout_at, ts) is a stream of the jobs as they become; a later update
    (a lock that is held on, a job that is done) takes the timers' place. A job is moved on by its earliest timer.
    """
    use_rocksdb(updates.sparkSession)
    return updates.withWatermark("ts", late).groupBy("id").transformWithStateInPandas(JobTimers(most_attempts), MOVED, "Append", "EventTime")
