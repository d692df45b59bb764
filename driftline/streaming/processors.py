"""Stateful stream processors (``transformWithState``) that fold each key's rows in event time.

Rows may come in any order within the watermark's delay. They wait in the state as sorted runs until the
watermark has passed them; a timer that expires merges the runs whose first row is due, however many rows
wait in others. A call to the state costs about as much as a hundred rows, so the stream is grouped by a hash
of the key (:func:`grouped`) and the rows of a group of keys are filed together: calls grow with rows /
``chunk_rows`` and with at most ``GROUPS`` groups a micro-batch, not with the keys or the minutes that rows are
spread over. What a group keeps besides is one small entry for each of its keys that has something to remember:
the limiter the times granted within its window, the trigger a flag, the alert the start and length of the
present run.
"""

from __future__ import annotations

import heapq
import pickle
import sys
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftline.operators.incidents import MAX_RESTARTS, RESTART_WINDOW_MINUTES

# The state-schema check of transformWithState unpickles the processor in a
# driver-side Python process that does not see shipped py-files; pickling this
# module's classes by value makes them self-contained.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Keys are dealt to so many groups, each with its own place in the state. An open stream's state depends on it.
GROUPS = 4096
#: Rows of a result that are handed over at once.
FRAME_ROWS = 10_000
#: Fields that a waiting row can have, its key aside; a processor names those it folds, as each one costs time for every row.
WAITING = ("us", "event_id", "text", "status", "number")
#: The waiting runs of a group, column by column.
INDEX = T.StructType([T.StructField(name, T.ArrayType(T.LongType())) for name in ("buckets", "numbers", "firsts", "sizes")])
#: The rows of a run, pickled column by column: the state takes them in one piece and not value by value.
CHUNK = T.StructType([T.StructField("rows", T.BinaryType())])
#: What a group remembers of its keys: a pickled dictionary.
KEPT = T.StructType([T.StructField("keys", T.BinaryType())])

LIMITER_OUT = T.StructType([
    T.StructField("us", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("container", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("action", T.StringType()), T.StructField("message", T.StringType()),
])
TRIGGER_OUT = T.StructType([T.StructField("us", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType())])
ALERT_OUT = T.StructType([
    T.StructField("us", T.LongType()), T.StructField("series", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("start_us", T.LongType()), T.StructField("n_samples", T.LongType()),
])


class Run(NamedTuple):
    """Waiting rows in order: the bucket and the time of the first, a number of its own among the group's runs, how many."""

    bucket: int
    number: int
    first: int
    size: int


def _in_order(row: tuple) -> tuple:
    """Rows go by time and event id, a missing id last."""
    return row[0], row[1] is None, row[1] or 0


class EventTimeFold(StatefulProcessor):
    """Folds the rows of each key of a group in event time, whatever order they come in within the watermark's delay.

    Input rows carry ``us`` (their time in microseconds, so no time zone is involved), ``event_id`` and the other
    ``fields``; a waiting row has its key behind them. Every ``held_rows`` of them are sorted and filed as runs of at
    most ``chunk_rows``; runs that are no longer than what comes in are taken up into it, so a group with few rows a
    micro-batch does not pile up short ones. A short index holds the first time of each run, and a timer stands at
    the earliest of all. When the watermark passes it, the runs that have begun are merged, each read when its first
    row is reached, and their rows up to the watermark folded, ordered by (time, event id). What is left of them is
    filed anew, short runs first: those are the next ones to be read.
    """

    fields = WAITING
    bucket_us = 60_000_000
    chunk_rows = 1000
    held_rows = 10_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.index = handle.getValueState("index", INDEX)
        self.chunks = handle.getMapState(
            "chunks", T.StructType([T.StructField("bucket", T.LongType()), T.StructField("number", T.LongType())]), CHUNK)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", KEPT)

    def fold(self, key, rows):
        """Folds ``rows`` of the keys of group ``key``, all of them in order; yields rows of the result."""
        raise NotImplementedError

    def _remembered(self) -> dict:
        held = self.kept.get()
        return pickle.loads(held[0]) if held else {}

    def _remember(self, keys: dict) -> None:
        if keys:
            self.kept.update((pickle.dumps(keys, pickle.HIGHEST_PROTOCOL),))
        else:
            self.kept.clear()

    def _waiting(self) -> list[Run]:
        held = self.index.get()
        return [Run(*r) for r in zip(*held)] if held else []

    def _keep(self, waiting: list[Run], alarm: int | None) -> None:
        """Write the index; ``alarm`` is the time that a timer stands at already."""
        if not waiting:
            self.index.clear()
            return
        self.index.update(tuple(list(c) for c in zip(*waiting)))
        first = min(r.first for r in waiting)
        if alarm is None or first < alarm:
            self.handle.registerTimer(-(-first // 1000))

    def _file(self, waiting: list[Run], rows: list[tuple], size: int) -> None:
        """File ``rows`` as runs of ``size`` rows, each next one twice as long, up to ``chunk_rows``."""
        rows.sort(key=_in_order)
        number = max((r.number for r in waiting), default=-1) + 1
        at = 0
        while at < len(rows):
            some = rows[at:at + size]
            run = Run(some[0][0] // self.bucket_us, number, some[0][0], len(some))
            self.chunks.updateValue(run[:2], (pickle.dumps(tuple(zip(*some)), pickle.HIGHEST_PROTOCOL),))
            waiting.append(run)
            number, at, size = number + 1, at + size, min(2 * size, self.chunk_rows)

    def _append(self, waiting: list[Run], rows: list[tuple]) -> None:
        """File rows that came in, together with the runs that are no longer than they are."""
        for run in sorted((r for r in waiting if r.size < self.chunk_rows), key=lambda r: r.size):
            if run.size > len(rows) or run.size + len(rows) > self.chunk_rows:
                break
            waiting.remove(run)
            rows += self._take(run)
        self._file(waiting, rows, self.chunk_rows)

    def _take(self, run: Run) -> Iterator[tuple]:
        columns = pickle.loads(self.chunks.getValue(run[:2])[0])
        self.chunks.removeKey(run[:2])
        return zip(*columns)

    def _merged(self, runs: list[Run], passed: int, later: list[tuple]) -> Iterator[tuple]:
        """The rows of ``runs`` up to ``passed`` in order; the others are put into ``later``."""
        runs = sorted(runs, key=lambda r: r.first, reverse=True)
        heads: list[tuple] = []  # the next row of each run that is being read
        while runs or heads:
            while runs and (not heads or runs[-1].first <= heads[0][0][0]):
                run = runs.pop()
                rest = self._take(run)
                row = next(rest)
                heapq.heappush(heads, (_in_order(row), run.number, row, rest))
            _, number, row, rest = heads[0]
            if row[0] > passed:
                later.append(row)
                later.extend(rest)
                heapq.heappop(heads)
                continue
            yield row
            row = next(rest, None)
            if row is None:
                heapq.heappop(heads)
            else:
                heapq.heapreplace(heads, (_in_order(row), number, row, rest))

    def handleInputRows(self, key, rows, timerValues):
        self.hold(tuple([r[f] for f in self.fields]) + (key[0],) for r in rows)
        return iter(())

    def hold(self, rows: Iterator[tuple]) -> None:
        """File rows that came in for one group, each with its key at its end."""
        waiting = self._waiting()
        alarm = min((r.first for r in waiting), default=None)
        held: list[tuple] = []
        for r in rows:
            held.append(r)
            if len(held) == self.held_rows:
                self._append(waiting, held)
                held = []
        if held:
            self._append(waiting, held)
        self._keep(waiting, alarm)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = self._waiting()
        due = [r for r in waiting if r.first <= passed]
        if due:
            waiting = [r for r in waiting if r.first > passed]
            later: list[tuple] = []
            yield from self.fold(key, self._merged(due, passed, later))
            self._file(waiting, later, max(1, self.chunk_rows // 16))
            self._keep(waiting, None)

    def close(self) -> None:
        pass


class RestartLimiter(EventTimeFold):
    """W9/T3/F17 in event time; ``text`` is the incident."""

    fields = ("us", "event_id", "text", "status")
    max_restarts = MAX_RESTARTS
    window_us = RESTART_WINDOW_MINUTES * 60_000_000

    def fold(self, key, rows):
        granted = self._remembered()
        us = None
        for us, event_id, incident, status, container in rows:
            held = [g for g in granted.get(container, ()) if g > us - self.window_us]
            ok = len(held) < self.max_restarts
            if ok:
                held.append(us)
            granted[container] = held
            yield Row(us=us, event_id=event_id, container=container, status=status, action="restart" if ok else "alert",
                      message=incident + ("; restarted" if ok else "; restart limit reached"))
        if us is not None:  # no later row has an earlier time, so what has left the window counts no more
            self._remember({k: held for k, held in granted.items() if held and held[-1] > us - self.window_us})


class DriftTrigger(EventTimeFold):
    """T4 in event time; ``number`` is the score, null for a finished run."""

    fields = ("us", "event_id", "number")
    threshold = 0.5

    def fold(self, key, rows):
        active = self._remembered()
        was = set(active)
        for us, event_id, score, user_id in rows:
            if score is None:
                active.pop(user_id, None)
            elif score > self.threshold and user_id not in active:
                active[user_id] = True
                yield Row(us=us, user_id=user_id, event_id=event_id)
        if active.keys() != was:
            self._remember(active)


class SustainedAlert(EventTimeFold):
    """Pending at the first sample above ``threshold``, firing once the run above it has lasted ``for_us``, resolved at the
    first sample that is not above. ``number`` is the value; a missing one is not above."""

    fields = ("us", "event_id", "number")

    def __init__(self, threshold: float, for_seconds: float) -> None:
        self.threshold, self.for_us = threshold, round(for_seconds * 1_000_000)

    def fold(self, key, rows):
        runs = self._remembered()  # start, length, whether it fires
        for us, _, value, series in rows:
            if value is not None and value > self.threshold:
                states = []
                if series not in runs:
                    runs[series] = us, 0, False
                    states.append("pending")
                start, n, fires = runs[series]
                n += 1
                if not fires and us - start >= self.for_us:
                    fires = True
                    states.append("firing")
                runs[series] = start, n, fires
                yield from (Row(us=us, series=series, state=s, start_us=start, n_samples=n) for s in states)
            elif series in runs:
                start, n, _ = runs.pop(series)
                yield Row(us=us, series=series, state="resolved", start_us=start, n_samples=n)
        self._remember(runs)


class InFrames(StatefulProcessor):
    """A fold whose input and result pass as pandas frames, whole columns at a time.

    No column of the input is null, as pandas would turn whole numbers into floats: ``missing`` has a bit for each
    field, the key last, whose value stands for a null.
    """

    def __init__(self, fold: EventTimeFold, out: T.StructType) -> None:
        self.fold, self.out = fold, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold.init(handle)

    def _rows(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            missing, columns = frame["missing"].to_numpy(), []
            for i, name in enumerate((*self.fold.fields, "key")):
                values, absent = frame[name].tolist(), missing & (1 << i) != 0
                columns.append([None if a else v for v, a in zip(values, absent)] if absent.any() else values)
            yield from zip(*columns)

    def _frame(self, rows: list[Row]) -> pd.DataFrame:
        return pd.DataFrame({f.name: pd.Series(list(column), dtype="Int64" if isinstance(f.dataType, T.LongType) else "object")
                             for f, column in zip(self.out, zip(*rows))})

    def handleInputRows(self, key, rows, timerValues):
        self.fold.hold(self._rows(rows))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        rows: list[Row] = []
        for row in self.fold.handleExpiredTimer(key, timerValues, expiredTimerInfo):
            rows.append(row)
            if len(rows) == FRAME_ROWS:
                yield self._frame(rows)
                rows = []
        if rows:
            yield self._frame(rows)

    def close(self) -> None:
        self.fold.close()


def grouped(rows: DataFrame, ts: str, key: Column, fold: EventTimeFold, out: T.StructType) -> DataFrame:
    """``fold`` over a watermarked stream with the fields it names, in event time, for each ``key``.

    Spark sets the key of the state, lists timers and hands over results group by group: with a group for each
    container or model, that was the larger part of the work.
    """
    columns = {"us": F.unix_micros(ts), **{f: F.col(f) for f in fold.fields[1:]}, "key": key}
    types = dict(rows.select(*(c.alias(name) for name, c in columns.items())).dtypes)
    missing = reduce(Column.bitwiseOR, [F.when(c.isNull(), 1 << i).otherwise(0) for i, c in enumerate(columns.values())])
    dealt = rows.select(
        F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("group"), ts, missing.alias("missing"),
        *(F.coalesce(c, F.lit("" if types[name] == "string" else 0).cast(types[name])).alias(name) for name, c in columns.items()))
    return dealt.groupBy("group").transformWithStateInPandas(InFrames(fold, out), out, "Append", "EventTime")
