"""Streams with files out of order, one file per trigger, against plain loops; replays and crashes of sinks."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import logs
from driftline.plans import streams
from driftline.session import scratch_path
from driftline.streaming import processors, sinks
from driftline.streaming.runner import file_stream, run_available_now, use_rocksdb_state

T0 = dt.datetime(2024, 1, 1, 10)


def land(spark, rows, schema, parts):
    folder = scratch_path(spark, "landing")
    step = -(-len(rows) // parts)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k:k + step], schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def plain_alerts(rows, threshold, seconds):
    out = []
    for series in {r[1] for r in rows}:
        start, n, fires = None, 0, False
        for ts, _, i, value in sorted((r for r in rows if r[1] == series), key=lambda r: (r[0], r[2])):
            if value is not None and value > threshold:
                if start is None:
                    start, n, fires = ts, 0, False
                    out.append((series, "pending", ts, start, 1))
                n += 1
                if not fires and (ts - start).total_seconds() >= seconds:
                    fires = True
                    out.append((series, "firing", ts, start, n))
            elif start is not None:
                out.append((series, "resolved", ts, start, n))
                start = None
    return sorted(out)


@pytest.mark.parametrize("bucket_us, chunk_rows, held_rows", [(60_000_000, 1000, 10_000), (7_000, 2, 5), (3_600_000_000, 3, 4)])
def test_alert_stream_with_files_out_of_order(spark, monkeypatch, bucket_us, chunk_rows, held_rows):
    for name, value in (("bucket_us", bucket_us), ("chunk_rows", chunk_rows), ("held_rows", held_rows)):
        monkeypatch.setattr(processors.EventTimeFold, name, value)
    rng = random.Random(7)
    rows = [(T0 + dt.timedelta(microseconds=rng.randrange(3 * 3600 * 10**6)), f"s{rng.randrange(3)}", i, rng.choice([0.1, 0.6, 0.7, 0.9, None]))
            for i in range(250)]
    rows += [(T0 + dt.timedelta(seconds=600 * k), "s0", 500 + k, 0.9) for k in range(8)] + [(rows[3][0], rows[3][1], 600, 0.2)]  # a tie
    last = [(T0 + dt.timedelta(hours=9), "beat", 999, 0.0)]
    arrival = sorted(rows, key=lambda r: r[0] + dt.timedelta(seconds=rng.randrange(480))) + last
    schema = "ts timestamp, series string, event_id long, value double"
    use_rocksdb_state(spark)
    stream = file_stream(spark, land(spark, arrival, schema, 5), spark.createDataFrame([], schema).schema, max_files=1)
    out = run_available_now(streams.alerts(stream, 0.5, 900), "alerts_test").select(
        "series", "state", F.timestamp_micros("us"), F.timestamp_micros("start_us"), "n_samples")
    assert sorted(map(tuple, out.collect())) == plain_alerts(rows, 0.5, 900)


def test_a_timer_reads_only_what_is_due():
    """The fold's own calls, against a state that notes the buckets it hands out."""
    read, timers, handing_out = [], [], []

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    class Map:
        def __init__(self):
            self.held = {}

        def getValue(self, key):
            if handing_out:
                read.append(key[0])
            return self.held[key]

        def updateValue(self, key, value):
            self.held[key] = value

        def removeKey(self, key):
            del self.held[key]

    class Handle:
        getMapState = staticmethod(lambda *a: Map())
        getValueState = staticmethod(lambda *a: Value())
        registerTimer = staticmethod(timers.append)

    class Times:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    class Collect(processors.EventTimeFold):
        chunk_rows = 7

        def open(self, handle):
            pass

        def fold(self, key, rows):
            yield from rows

    fold, seen = Collect(), []
    fold.init(Handle())
    rows = [{"us": k * 1_000_000, "event_id": k, "text": None, "status": None, "number": 1.0} for k in range(1, 6000)]
    random.Random(1).shuffle(rows)
    for k in range(0, len(rows), 500):
        list(fold.handleInputRows(("k",), iter(rows[k:k + 500]), None))
    handing_out.append(True)
    assert timers[-1] <= 1000 * min(r["event_id"] for r in rows)
    for ms in (600_500, 600_500, 3_000_000, 10**9):
        del read[:]
        before = len(seen)
        seen += fold.handleExpiredTimer(("k",), Times(ms), None)
        assert set(read) <= set(range((before + 1) // 60, ms // 60_000 + 1))
        assert len(seen) == min(5999, ms // 1000)
    assert [r[1] for r in seen] == list(range(1, 6000)) and timers[-1] == 3_001_000


def test_top_of_window(spark):
    rows = [(1, "a" * 200 + str(i), 50 - i % 3) for i in range(30)] + [(2, "x", 2), (2, "y", 3)]
    out = logs.top_of_window(spark.createDataFrame(rows, "window_start int, message string, cnt long")).collect()
    first = sorted((r for r in rows if r[0] == 1), key=lambda r: (-r[2], r[1]))[:20]
    assert sum(r["window_start"] == 1 for r in out) == 20 and {r["total_top"] for r in out if r["window_start"] == 1} == {sum(r[2] for r in first)}
    assert {len(r["message"]) for r in out if r["window_start"] == 1} == {120}
    assert {(r["message"], r["cnt"], r["is_urgent"], r["total_top"]) for r in out if r["window_start"] == 2} == {("x", 2, False, 5), ("y", 3, True, 5)}


EVENTS = "ts timestamp, event_type string, value double, event_id long"


def events(n, seed=3):
    rng = random.Random(seed)
    return [(T0 + dt.timedelta(seconds=60 * k + rng.randrange(60)), rng.choice(["click", "error"]), float(rng.randrange(100)), k) for k in range(n)]


def want_of(rows):
    out = {}
    for ts, kind, value, _ in rows:
        key = ts.replace(minute=0, second=0), "api" if kind == "click" else "predict_api_service"
        out.setdefault(key, []).append(value)
    return sorted((*k, len(v), round(sum(v) / len(v), 6)) for k, v in out.items())


@pytest.mark.parametrize("killed_at", ["before the commit", "in the middle of the write", "in the compaction"])
def test_updates_survive_a_lost_driver(spark, monkeypatch, killed_at):
    rows, keys = events(400), ["window_start", "job"]
    landing, table, ckpt = land(spark, rows, EVENTS, 8), scratch_path(spark, "table"), scratch_path(spark, "ckpt")
    schema = spark.createDataFrame([], EVENTS).schema

    def run():
        sinks.run_updates(streams.open_windows(file_stream(spark, landing, schema, max_files=1)), table, keys, ckpt, compact_after=3)

    write, compact, calls = sinks.write_update, sinks.compact, []

    def lost_write(batch, at, number):
        calls.append(number)
        if number == 5 and calls.count(5) == 1:
            if killed_at == "before the commit":
                write(batch, at, number)
            else:  # files of a part of the rows, without the mark of success
                write(batch.limit(1), at, number)
                mark = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/batches/5/_SUCCESS")
                mark.getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, False)
            raise RuntimeError("lost")
        write(batch, at, number)

    def lost_compact(s, at, k, after):
        if calls == [] and len(sinks._pending(s, at, sinks.VersionedTable(s, f"{at}/merged").manifest().properties["upto"])) > after:
            calls.append("lost")
            raise RuntimeError("lost")
        compact(s, at, k, after)

    monkeypatch.setattr(*((sinks, "compact", lost_compact) if killed_at == "in the compaction" else (sinks, "write_update", lost_write)))
    with pytest.raises(Exception):
        run()
    seen = sinks.current(spark, table, keys).select("window_start", "job", "n", "avg_latency_ms")
    assert seen.groupBy("window_start", "job").count().filter("count > 1").count() == 0
    run()
    got = sinks.current(spark, table, keys).select("window_start", "job", "n", "avg_latency_ms")
    assert sorted(map(tuple, got.collect())) == want_of(rows)
    run()  # nothing new
    assert sorted(map(tuple, sinks.current(spark, table, keys).select(*got.columns).collect())) == want_of(rows)
    assert sinks.VersionedTable(spark, f"{table}/merged").manifest().properties["upto"] >= 2
    # one batch replayed by hand: the table stays the same
    last = max(sinks._pending(spark, table, -1))
    again = spark.read.parquet(f"{table}/batches/{last}").drop(sinks.BATCH)
    again = spark.createDataFrame(again.collect(), again.schema)
    write(again, table, last)
    assert sorted(map(tuple, sinks.current(spark, table, keys).select(*got.columns).collect())) == want_of(rows)


def test_open_windows_are_shown_before_they_close(spark):
    rows = events(90)
    table, keys = scratch_path(spark, "table"), ["window_start", "job"]
    schema = spark.createDataFrame([], EVENTS).schema
    sinks.run_updates(streams.open_windows(file_stream(spark, land(spark, rows, EVENTS, 1), schema)), table, keys, scratch_path(spark, "ckpt"))
    assert sorted(map(tuple, sinks.current(spark, table, keys).select(*keys, "n", "avg_latency_ms").collect())) == want_of(rows)


def test_polls_resume_from_the_kept_time(spark):
    rows = events(120)
    landing, table, ckpt = land(spark, rows, EVENTS, 6), scratch_path(spark, "polls"), scratch_path(spark, "ckpt")
    schema = spark.createDataFrame([], EVENTS).schema
    made = []
    for stop in (2, 1, None, None):
        made.append(sinks.run_polls(file_stream(spark, landing, schema, max_files=1), table, ckpt, "ts", stop_after=stop))
        got, newest = sinks.polled(spark, table)
        assert sorted(r["event_id"] for r in got.collect()) == list(range(20 * sum(made)))
        seen = max(r[0] for r in rows[:20 * sum(made)])
        assert newest == got.agg(F.unix_micros(F.max("ts"))).first()[0] and got.agg(F.max("ts")).first()[0] == seen
    assert made == [2, 1, 3, 0]


class CountedState:
    """A state in memory that counts the calls made to it."""

    def __init__(self):
        self.calls, self.value, self.held, self.timers = 0, None, {}, []

    def getValueState(self, *_):
        return CountedState.of(self, CountedState())

    getMapState = getValueState

    @staticmethod
    def of(owner, own):
        class Counted:
            def __getattribute__(_, name):
                owner.calls += 1
                return getattr(own, name)
        return Counted()

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.append(ms)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_calls_to_the_state_do_not_grow_with_the_minutes_of_a_key():
    """A key's rows lie in minutes of their own: calls per row made jobs of six gigabytes last hours."""
    state, fold = CountedState(), processors.DriftTrigger()
    fold.init(state)
    rows = [{"us": k * 3_600_000_000, "event_id": k, "text": None, "status": None, "number": 200.0 if k % 2 else None} for k in range(1, 401)]
    random.Random(2).shuffle(rows)
    list(fold.handleInputRows((1,), iter(rows), None))
    out = list(fold.handleExpiredTimer((1,), Clock(10**10), None))
    assert [r["event_id"] for r in out] == list(range(1, 400, 2)) and state.calls <= 20


@pytest.mark.parametrize("at_once", [1, 3, 40])
def test_a_trickle_of_rows_piles_up_no_short_runs(at_once):
    """Few rows a call, watermark close behind: order kept, rows missing an id and ties included, few runs in the state."""
    class Collect(processors.EventTimeFold):
        chunk_rows = 100

        def open(self, handle):
            pass

        def fold(self, key, rows):
            yield from rows

    rng, state, fold, out, most = random.Random(at_once), CountedState(), Collect(), [], 0
    fold.init(state)
    rows = [{"us": (k // 2) * 1_000_000, "event_id": rng.choice([k, None]), "text": None, "status": None, "number": float(k)} for k in range(2400)]
    arrival = sorted(rows, key=lambda r: r["us"] + rng.randrange(300_000_000))
    newest = 0
    for k in range(0, len(rows), at_once):
        some = arrival[k:k + at_once]
        list(fold.handleInputRows(("k",), iter(some), None))
        newest = max(newest, *(r["us"] for r in some), 0)
        out += fold.handleExpiredTimer(("k",), Clock(newest // 1000 - 300_000), None)
        most = max(most, len(fold._waiting()))
    out += fold.handleExpiredTimer(("k",), Clock(10**10), None)
    want = sorted(rows, key=lambda r: (r["us"], r["event_id"] is None, r["event_id"] or 0))
    assert [r[:2] for r in out] == [(r["us"], r["event_id"]) for r in want] and sorted(r[4] for r in out) == [float(k) for k in range(2400)]
    assert most <= 60 and not fold._waiting()


def plain_triggers(rows):
    """(us, user, event id) of (us, user, event id, score); a missing score ends the run."""
    active, out = set(), []
    for us, user, i, score in sorted(rows, key=lambda r: (r[0], r[2] is None, r[2] or 0)):
        if score is None:
            active.discard(user)
        elif score > 0.5 and user not in active:
            active.add(user)
            out.append((us, user, i))
    return out


def in_frame(rows):
    """Rows as the stream hands them to a fold of a group: nulls replaced and marked."""
    return pd.DataFrame({
        "us": [r[0] for r in rows], "event_id": [r[2] or 0 for r in rows], "number": [r[3] or 0.0 for r in rows],
        "key": [r[1] or 0 for r in rows], "missing": [2 * (r[2] is None) + 4 * (r[3] is None) + 8 * (r[1] is None) for r in rows]})


def test_calls_to_the_state_do_not_grow_with_the_keys():
    """Each key had some ten calls of its own: at six gigabytes they were the larger part of the job."""
    rng, state = random.Random(5), CountedState()
    fold = processors.InFrames(processors.DriftTrigger(), processors.TRIGGER_OUT)
    fold.init(state)
    rows = [(k * 7_000_000, rng.choice([None, *range(400)]), rng.choice([None, 2**53 + 1 + k]), rng.choice([None, 0.2, 0.9, float("nan")]))
            for k in range(3000)]
    arrival = sorted(rows, key=lambda r: r[0] + rng.randrange(3_000_000_000))
    out = []
    for k in range(0, 3000, 1500):
        list(fold.handleInputRows((0,), iter([in_frame(arrival[k:k + 700]), in_frame(arrival[k + 700:k + 1500])]), None))
        out += fold.handleExpiredTimer((0,), Clock(arrival[k + 1499][0] // 1000 - 3_000_000 if k == 0 else 10**10), None)
    assert state.calls <= 60
    got = [tuple(None if pd.isna(v) else v for v in r) for frame in out for r in frame.astype(object).itertuples(index=False)]
    assert got == plain_triggers(rows)


@pytest.mark.parametrize("groups", [1, 3, 4096])
def test_keys_of_a_group_are_folded_apart(spark, monkeypatch, groups):
    monkeypatch.setattr(processors, "GROUPS", groups)
    rng = random.Random(groups)
    rows = [(T0 + dt.timedelta(seconds=20 * k), f"c{rng.randrange(5)}" if k % 50 else None, 2**53 + 1 + k if k % 9 else None, f"down {k}", "exited") for k in range(400)]
    arrival = sorted(rows, key=lambda r: r[0] + dt.timedelta(seconds=rng.randrange(480)))
    arrival.append((T0 + dt.timedelta(hours=9), "beat", 1, "up", "running"))
    schema = "ts timestamp, container string, event_id long, text string, status string"
    use_rocksdb_state(spark)
    stream = file_stream(spark, land(spark, arrival, schema, 4), spark.createDataFrame([], schema).schema, max_files=1)
    out = run_available_now(streams.limited(stream.withWatermark("ts", "10 minutes")), "limited_test")
    want, granted = [], {}
    for ts, container, i, text, status in rows:
        held = [g for g in granted.get(container, []) if g > ts - dt.timedelta(minutes=10)]
        ok = len(held) < 3
        granted[container] = held + [ts] * ok
        want.append((ts, container, i, status, "restart" if ok else "alert", text + ("; restarted" if ok else "; restart limit reached")))
    got = out.select(F.timestamp_micros("us"), "container", "event_id", "status", "action", "message").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
