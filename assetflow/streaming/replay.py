"""Stable files and repeats over events that come out of order, with state that ends.

A path's rows wait in keyed state until no row up to ``lateness`` behind the path's newest could still come before them; then they are walked
in order of time and number.  What still waits is walked once nothing has come to the path for ``wait`` of clock time, and ``ttl``
later all that is held of the path is dropped.  So the result does not depend on how a log is split into micro-batches, and an idle path costs nothing.
Paths share keys of the state by hash: a key's timer runs at the first of its paths' times, and its state is read and written once a micro-batch.
Rows behind what was walked are told, with a null ``episode``, and change nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assetflow.streaming.watch import (
    _BLOCK, BUCKETS, MAX_PROBES, QUIET_SECONDS, SAID, Event, Known, bucketed, by_path, events_of, load_block, said, save_block, set_timer, walk_repeats, walk_stable,
)


class OrderedBucket(StatefulProcessor):
    """Rows of the paths of a bucket in order; ``walk`` reads a path's and returns what it has to remember."""

    def __init__(self, lateness_ms: float, wait_ms: float, ttl_ms: float) -> None:
        self.lateness, self.wait, self.ttl = int(lateness_ms * 1000), int(wait_ms), int(ttl_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", _BLOCK)
        self.known = handle.getValueState("known", _BLOCK)

    def walk(self, rows: list[Event], known: Known) -> tuple[list[Event], Known]:
        raise NotImplementedError

    def _run(self, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        # when a path's timer is due, the time up to which it was walked (null: not yet), and what was remembered then
        known = {path: (due, walked, tuple(memory)) for path, due, walked, *memory in load_block(self.known)}
        waiting: dict[str, list[Event]] = {}
        for path, *event in load_block(self.waiting):
            waiting.setdefault(path, []).append(tuple(event))

        def settle(path: str, ready: list[Event], after: int) -> None:
            _, walked, memory = known.get(path, (None, None, self.nothing))
            if ready:
                told, memory = self.walk(ready, memory if walked is not None else None)
                out.extend((path, *e) for e in told)
                walked = ready[-1][0]
            known[path] = now + after, walked, memory

        for path, events in by_path(rows).items():
            floor = known[path][1] if path in known else None
            late = [e for e in events if floor is not None and e[0] <= floor]
            held = waiting.pop(path, []) + [e for e in events if floor is None or e[0] > floor]
            held.sort(key=lambda e: (e[0], e[1] or 0))
            horizon = (held[-1][0] if held else 0) - self.lateness
            cut = sum(e[0] <= horizon for e in held)
            settle(path, held[:cut], self.wait)
            out.extend((path, *e[:4], None) for e in late)
            if held[cut:]:
                waiting[path] = held[cut:]
        for path in [p for p, (due, *_) in known.items() if due <= now]:
            if path in waiting:
                settle(path, waiting.pop(path), self.ttl)
            else:
                del known[path]
        save_block(self.waiting, [(path, *e) for path, events in waiting.items() for e in events])
        save_block(self.known, [(path, due, walked, *memory) for path, (due, walked, memory) in known.items()])
        set_timer(self.handle, [due for due, *_ in known.values()])
        yield said(out)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._run(rows, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(iter(()), timerValues)

    def close(self) -> None:
        pass


class StableInOrder(OrderedBucket):
    """A path is ready once two probes in a row agree; episodes are numbered from 1, anew after the path was dropped."""

    nothing = (None,) * 6

    def __init__(self, gap_ms: float, limit: int, *times: float) -> None:
        super().__init__(*times)
        self.gap, self.limit = int(gap_ms * 1000), limit

    def walk(self, rows: list[Event], known: Known) -> tuple[list[Event], Known]:
        return walk_stable(rows, known, self.gap, self.limit)


class RepeatsInOrder(OrderedBucket):
    """Passes a ready file on unless it was signalled with the same state before."""

    nothing = (None,) * 2

    def walk(self, rows: list[Event], known: Known) -> tuple[list[Event], Known]:
        return walk_repeats(rows, known)


# The driver-side check of a stateful stream imports nothing shipped with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _ordered(events: DataFrame, processor: OrderedBucket, buckets: int) -> DataFrame:
    rows = bucketed(events_of(events), buckets)
    got = rows.transformWithStateInPandas(processor, SAID, outputMode="Append", timeMode="ProcessingTime")
    time = lambda c: F.timestamp_micros(f"{c}_us" if c != "ts" else "us").alias(c)
    return got.select("path_key", "episode", time("ts"), "length", time("modified"), F.col("tie").alias("event_id"))


def stable_in_order(
    probes: DataFrame, gap_ms: float = QUIET_SECONDS * 1000, lateness_ms: float = 10_000, wait_ms: float | None = None, ttl_ms: float = 86_400_000, limit: int = MAX_PROBES,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``path_key, episode, ts, length, modified, event_id`` of files that became stable.  ``probes`` has ``path_key, ts, length, modified`` and may
    have ``event_id``, which orders equal times; rows without a time are not probes.  Needs the RocksDB state store and a trigger that
    goes on without data."""
    wait = gap_ms if wait_ms is None else wait_ms
    return _ordered(probes, StableInOrder(gap_ms, limit, lateness_ms, wait, ttl_ms), buckets)


def repeats_in_order(
    ready: DataFrame, lateness_ms: float = 10_000, wait_ms: float = QUIET_SECONDS * 1000, ttl_ms: float = 86_400_000, buckets: int = BUCKETS
) -> DataFrame:
    """Ready files without those that repeat the state signalled before; after ``ttl_ms`` without a signal a repeat is told again."""
    return _ordered(ready, RepeatsInOrder(lateness_ms, wait_ms, ttl_ms), buckets)
