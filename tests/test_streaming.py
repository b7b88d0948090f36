"""Streams and their batch twins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fathomline.streaming import ingest as I
from fathomline.streaming import state

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def events(spark):
    hours = [0, 20, 40, 66, 67, 100]
    return spark.createDataFrame([(i, "k", at(3600 * h)) for i, h in enumerate(hours)], "event_id long, key string, ts timestamp")


def test_ttl_slides_on_every_hit(events):
    got = sorted(r["event_id"] for r in I.stateful_batch(events, ["key"], "dedup").collect())
    assert got == [0, 3, 5]


def test_only_accepted_events_fill_the_rate_window(spark):
    df = spark.createDataFrame([(i, "s", at(t)) for i, t in enumerate([0, 1, 2, 9, 10.5, 11.5])], "event_id long, key string, ts timestamp")
    got = sorted(r["event_id"] for r in I.stateful_batch(df, ["key"], "rate", limit=2).collect())
    assert got == [0, 1, 4, 5]


def test_throttle_counts_from_the_last_accepted(spark):
    df = spark.createDataFrame([(i, "s", at(t)) for i, t in enumerate([0, 200, 299, 300, 500, 700])], "event_id long, key string, ts timestamp")
    assert sorted(r["event_id"] for r in I.stateful_batch(df, ["key"], "throttle").collect()) == [0, 3, 5]


def test_a_limited_event_has_claimed_its_hash(spark):
    data = [(i, "src", f"h{i}", "c", at(i / 100)) for i in range(101)] + [(101, "src", "h100", "c", at(60))]
    df = spark.createDataFrame(data, "event_id long, source_kind string, content_hash string, content string, ts timestamp")
    kept = {r["event_id"] for r in I.ingest_batch(df, "source_kind", ["source_kind", "content_hash"], []).collect()}
    assert kept == set(range(100))


def run_stream(spark, files, make, name, tmp_path):
    """The rows that a stream gives for tables that arrive one after another, and its keys left in state."""
    for k, df in enumerate(files):
        df.coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    source = spark.readStream.schema(files[0].schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    q = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    return spark.table(name).collect(), q.lastProgress["stateOperators"][0]["numRowsTotal"]


@pytest.mark.parametrize("kind,options", [("dedup", {}), ("throttle", {"seconds": 30000.0}), ("rate", {"limit": 1, "seconds": 80000.0})])
def test_stream_agrees_with_its_twin(spark, events, tmp_path, kind, options):
    files = [events.filter(f"event_id div 3 = {i}") for i in range(2)]
    rows, _ = run_stream(spark, files, lambda s: state.expiring_stream(s, ["key"], kind, **options), f"out_{kind}", tmp_path)
    assert sorted(r["event_id"] for r in rows) == sorted(r["event_id"] for r in I.stateful_batch(events, ["key"], kind, **options).collect())


def test_state_of_dead_keys_goes(spark, tmp_path):
    """Fifty keys come once, then one key long after: the fifty leave no state, and a key that returns is fresh."""
    kind = "event_id long, key string, ts timestamp"
    files = [
        spark.createDataFrame([(i, f"k{i}", at(i)) for i in range(50)], kind),
        spark.createDataFrame([(100, "late", at(3 * 86400))], kind),
        spark.createDataFrame([(101, "k7", at(3 * 86400 + 60)), (102, "k7", at(3 * 86400 + 90))], kind),
    ]
    rows, left = run_stream(spark, files, lambda s: state.expiring_stream(s, ["key"], "dedup"), "dead_keys", tmp_path)
    assert sorted(r["event_id"] for r in rows) == [*range(50), 100, 101]
    assert left <= 2 * 3  # two keys, each with its times and its timer


def test_jobs_are_moved_on_by_timers(spark, tmp_path):
    kind = "id long, status string, attempts long, delay_until timestamp, lock_until timestamp, timeout_at timestamp, ts timestamp"
    jobs = [
        (1, "delayed", 0, at(50), None, None, at(0)), (2, "active", 2, None, at(50), at(990), at(0)), (3, "active", 0, None, at(50), at(990), at(0)),
        (4, "active", 0, None, at(990), at(50), at(0)), (5, "active", 0, None, at(50), at(990), at(1)), (6, "active", 0, None, at(60), None, at(1)), (7, "delayed", 1, at(5000), None, None, at(1)),
    ]
    held = [(5, "active", 0, None, at(900), at(990), at(40)), (6, "completed", 0, None, None, None, at(41))]
    clock = [(99, "waiting", 0, None, None, None, at(t)) for t in (100, 200)]
    files = [spark.createDataFrame(x, kind) for x in (jobs, held, clock[:1], clock[1:])]
    rows, left = run_stream(spark, files, lambda s: state.job_timers(s), "job_timers", tmp_path)
    moved = {r["id"]: (r["status"], r["attempts"]) for r in rows}
    assert moved == {1: ("waiting", 0), 2: ("dead", 3), 3: ("waiting", 1), 4: ("failed", 0)}
    assert {r["id"]: r["at"] for r in rows} == dict.fromkeys((1, 2, 3, 4), at(50))
    assert left <= 2 * 3  # jobs 5 and 7 still have theirs
    last = spark.createDataFrame([j for j in jobs if j[0] not in (5, 6)] + held, kind)
    twin = I.job_transitions(last, "2024-01-01 00:01:40").filter("next_status <> status").collect()
    assert {r["id"]: (r["next_status"], r["next_attempts"]) for r in twin} == moved


def test_rollup_stream_adds_up(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = I.rollup(source, "1 day").writeStream.outputMode("complete").format("memory").queryName("rollup").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r["start"], r["event_type"], r["n"], round(r["total"], 4))
    assert sorted(map(key, spark.table("rollup").collect())) == sorted(map(key, I.rollup(e, "1 day").collect()))


def test_watched_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("one\ntwo")
    q = I.watch_folder(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["content"] for r in spark.table("watched").collect()] == ["one\ntwo"]


def test_job_transitions(spark):
    data = [(1, "delayed", 0, at(5), None, None), (2, "active", 2, None, at(5), at(99)), (3, "active", 0, None, at(5), at(99)), (4, "active", 0, None, at(99), at(5)), (5, "active", 0, None, at(99), at(99))]
    df = spark.createDataFrame(data, "id int, status string, attempts int, delay_until timestamp, lock_until timestamp, timeout_at timestamp")
    got = {r["id"]: (r["next_status"], r["next_attempts"]) for r in I.job_transitions(df, "2024-01-01 00:00:10").collect()}
    assert got == {1: ("waiting", 0), 2: ("dead", 3), 3: ("waiting", 1), 4: ("failed", 0), 5: ("active", 0)}


def test_supervised_restarts():
    from fathomline.streaming.supervise import RestartPolicy, supervise

    now, slept, left = [0.0], [], [3]

    def run():
        now[0] += 400 if left[0] == 1 else 1
        left[0] -= 1
        if left[0] >= 0:
            raise RuntimeError("down")

    assert supervise(run, clock=lambda: now[0], sleep=slept.append) == 3
    assert slept == [1.0, 2.0, 1.0]  # the third run had lasted, so the count began anew
    with pytest.raises(ZeroDivisionError):
        supervise(lambda: 1 / 0, RestartPolicy(crashes=3), clock=lambda: 0.0, sleep=slept.append)


def test_objects_and_named_aggregates(spark, tmp_path):
    from fathomline.sources import plugins

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"abc")
    assert [r["size"] for r in plugins.objects(spark, str(tmp_path)).collect()] == [3]
    with pytest.raises(ValueError):
        plugins.aggregate_by_name(spark.range(1), ["id"], ["nothing"])


def numbers(part, parts):
    yield from ((i, i * i) for i in range(part, 10, parts))


def test_plugins(spark):
    from fathomline.sources import plugins

    plugins.register(spark)
    df = spark.read.format("fathomline_plugin").schema("id long, square long").option("function", "tests.test_streaming:numbers").option("partitions", "3").load()
    assert sorted(map(tuple, df.collect())) == [(i, i * i) for i in range(10)]
