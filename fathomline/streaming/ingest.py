"""Ingestion on Structured Streaming: validation, sliding de-duplication, rate limits, rollups, throttles.

``*_batch`` functions work on an ordered table; the streams of ``state`` share their pure state machines, so they agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DEDUP_TTL = 24 * 3600.0
RATE_LIMIT, RATE_WINDOW = 100, 10.0
THROTTLE = 300.0


def valid(events: DataFrame) -> DataFrame:
    """Events with a kind, a hash and a body."""
    return events.filter("source_kind is not null and length(content_hash) > 0 and content is not null")


def dedup_step(last: float | None, t: float, ttl: float = DEDUP_TTL) -> tuple[float, bool]:
    """(new state, fresh): the time to live starts again on every hit, so a key that keeps coming stays suppressed."""
    return t, last is None or t - last >= ttl


def rate_step(window: list[float], t: float, limit: int = RATE_LIMIT, seconds: float = RATE_WINDOW) -> tuple[list[float], bool]:
    """Only accepted events enter the window."""
    window = [x for x in window if t - x < seconds]
    return (window + [t], True) if len(window) < limit else (window, False)


def throttle_step(last: float | None, t: float, seconds: float = THROTTLE) -> tuple[float | None, bool]:
    """Relative to the last accepted event, not to the last one."""
    return (t, True) if last is None or t - last >= seconds else (last, False)


STEPS = {
    "dedup": (lambda s, t, **kw: dedup_step(s[0] if s else None, t, **kw), lambda x: [x]),
    "rate": (lambda s, t, **kw: rate_step(list(s), t, **kw), lambda x: x),
    "throttle": (lambda s, t, **kw: throttle_step(s[0] if s else None, t, **kw), lambda x: [] if x is None else [x]),
}


def _accepted(pdf: pd.DataFrame, state: list[float], kind: str, time: str, options: dict) -> tuple[pd.DataFrame, list[float]]:
    step, pack = STEPS[kind]
    pdf = pdf.sort_values([time, *[c for c in pdf.columns if c.endswith("_id")]], kind="stable")
    keep = []
    for t in pdf[time].astype("int64") / (1e9 if str(pdf[time].dtype).endswith("ns]") else 1e6):
        new, ok = step(state, float(t), **options)
        state = pack(new)
        keep.append(ok)
    return pdf[keep], state


#: Seconds of the slices in which a key's times are looked at for pauses, at least.
SLICE = 3600.0


def segments(events: DataFrame, keys: list[str], time: str, span: float) -> DataFrame:
    """(row, key, segment, t) of the events with a time: a key's segments are parted by pauses of ``span`` seconds or more.

    No state of this module outlives such a pause, so segments are independent. They are found from the first and last
    time of each key's slices, a small table; an event goes to its slice's segment, so a pause within a slice parts nothing.
    """
    t = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = events.select(F.struct("*").alias("row"), key.alias("key"), t.alias("t")).filter("t is not null")
    rows = rows.withColumn("slice", F.floor(F.col("t") / max(span, SLICE)))
    ends = rows.groupBy("key", "slice").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    w = W.partitionBy("key").orderBy("slice")
    pause = F.col("a") - F.lag("b").over(w)
    names = ends.withColumn("new", F.when(pause < span, 0).otherwise(1)).withColumn("segment", F.sum("new").over(w)).select("key", "slice", "segment")
    return rows.join(names, ["key", "slice"]).select("row", "key", "segment", "t")


def stateful_batch(events: DataFrame, keys: list[str], kind: str, time: str = "ts", **options) -> DataFrame:
    """The accepted events of a table, key by key in order of time and then of the columns that end in ``_id``.

    A key's independent segments are dealt to tasks apart, and a task streams through its sorted rows with the state alone
    in memory. Events without a time are left out.
    """
    step, pack = STEPS[kind]
    span = options.get("ttl", options.get("seconds", {"dedup": DEDUP_TTL, "rate": RATE_WINDOW, "throttle": THROTTLE}[kind]))
    ties = [F.col(f"row.`{c}`") for c in events.columns if c.endswith("_id")]
    rows = segments(events, keys, time, float(span)).repartition("key", "segment").sortWithinPartitions("key", "segment", "t", *ties)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, []
        for batch in batches:
            keep = []
            for k, g, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (k, g) != at:
                    at, state = (k, g), []
                new, ok = step(state, t, **options)
                state = pack(new)
                keep.append(ok)
            yield batch.select(["row"]).filter(pa.array(keep, pa.bool_()))

    kept = rows.mapInArrow(run, rows.select("row").schema)
    return kept.select("row.*")


def dedup_within_watermark(events: DataFrame, keys: list[str], time: str = "ts", delay: str = "24 hours") -> DataFrame:
    """Built-in form: the time to live does not slide."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def rollup(events: DataFrame, every: str = "60 seconds", time: str = "ts", late: str = "5 minutes") -> DataFrame:
    """Additive counters by tumbling window; in a stream, late events within the watermark are still counted."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", time: str = "ts") -> DataFrame:
    timed = events.withWatermark(time, "1 hour") if events.isStreaming else events
    return timed.groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def ingest_batch(events: DataFrame, source: str, keys: list[str], bulk: list[str]) -> DataFrame:
    """Duplicates first, then the rate limit by source: an event that the limiter drops has claimed its hash already.

    Bulk sources skip the de-duplication.
    """
    live = stateful_batch(valid(events.filter(~F.col(source).isin(*bulk))), keys, "dedup")
    return stateful_batch(live, [source], "rate").unionByName(valid(events.filter(F.col(source).isin(*bulk))))


def claim(jobs: DataFrame, workers: int) -> DataFrame:
    """The next jobs for a number of workers: by priority, then by age."""
    w = W.orderBy("priority", "created_at", "id")
    ready = jobs.filter("status = 'waiting'").orderBy("priority", "created_at", "id").limit(workers)
    return ready.withColumn("worker", F.row_number().over(w) - 1)


def job_transitions(jobs: DataFrame, now, most_attempts: int = 3) -> DataFrame:
    """Timer-driven states: delayed jobs are promoted, stalled ones requeued or given up, overlong ones timed out."""
    at = F.lit(now).cast("timestamp")
    lost = (F.col("status") == "active") & (F.col("lock_until") < at)
    state = (
        F.when((F.col("status") == "delayed") & (F.col("delay_until") <= at), "waiting")
        .when((F.col("status") == "active") & (F.col("timeout_at") < at), "failed")
        .when(lost & (F.col("attempts") + 1 >= most_attempts), "dead")
        .when(lost, "waiting")
        .otherwise(F.col("status"))
    )
    return jobs.withColumn("next_status", state).withColumn("next_attempts", F.col("attempts") + lost.cast("int"))


def watch_folder(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    """A stream of whole text files that arrive in a folder; ``most_files`` a trigger bounds the work taken on at once."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", str(most_files)).load(path)
    return _as_events(files, "file")


def inbox_folder(spark: SparkSession, path: str, done: str, most_files: int = 1000) -> DataFrame:
    """The same for an inbox: files that have been taken in are moved to the folder ``done``."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", str(most_files)).option("cleanSource", "archive").option("sourceArchiveDir", done).load(path)
    return _as_events(files, "inbox")


def _as_events(files: DataFrame, kind: str) -> DataFrame:
    return files.select(F.col("value").alias("content"), F.sha2("value", 256).alias("content_hash"), F.lit(kind).alias("source_kind"), F.current_timestamp().alias("ts"))


def learnings(spark: SparkSession, path: str) -> DataFrame:
    """A stream of learnings, one JSON object a line (type, key, insight, confidence); lines that are none are dropped."""
    lines = spark.readStream.schema("type string, key string, insight string, confidence double").json(path)
    body = F.concat_ws("\n", F.concat_ws(": ", "type", "key"), "insight")
    return lines.filter("key is not null and insight is not null").select(body.alias("content"), F.sha2(body, 256).alias("content_hash"), F.lit("learning").alias("source_kind"), F.current_timestamp().alias("ts"), "confidence")


def drained(stream: DataFrame, path: str) -> DataFrame:
    """What a stream has now, written under ``path`` by one available-now run and read again."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
