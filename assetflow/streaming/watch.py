"""Watching a folder as a stream: arrivals, quiet periods, stable files, repeats."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import cloudpickle
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assetflow.functions.content import extension_of
from assetflow.operators.ordered import first_per_key, islands, ordered_scan
from assetflow.schemas import SUPPORTED_INPUTS

# Quiet period after the last change, and probes before giving up.
QUIET_SECONDS, MAX_PROBES = 1.2, 12
# Keys of the state: paths share them by hash.  A key is read and written once a micro-batch, so its cost is shared by its paths; watches
# of many millions of paths take more.  It has to stay the same as long as a checkpoint is used.
BUCKETS = 1024

FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watched(events: DataFrame, exts: list[str] | None = None) -> DataFrame:
    """Events of files whose extension is allowed, with the case-insensitive key."""
    wanted = F.lower(extension_of("path")).isin(exts or SUPPORTED_INPUTS)
    return events.filter(wanted).withColumn("path_key", F.lower("path"))


def watch_source(spark: SparkSession, directory: str, recursive: bool = True, files_per_trigger: int = 1000) -> DataFrame:
    """New files below ``directory`` as a stream of ``path, modified, length``; contents are not read."""
    stream = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", str(recursive).lower())
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(directory)
    )
    return watched(stream.select("path", F.col("modificationTime").alias("modified"), "length"))


def debounce_stream(events: DataFrame, gap: str = "1200 milliseconds", watermark: str = "10 seconds") -> DataFrame:
    """``path_key, first_ts, last_ts, changes`` once a path has been quiet for ``gap``.
    The watermark bounds the open sessions kept; events later than it are dropped and the newest
    session of a path stays unsaid.  :func:`debounce_whole_stream` loses neither."""
    return (
        watched(events)
        .withWatermark("ts", watermark)
        .groupBy("path_key", F.session_window("ts", gap))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("changes"))
        .drop("session_window")
    )


def debounce_batch(events: DataFrame, gap_ms: float, tie: str = "event_id") -> DataFrame:
    """The same over a finished event log: the last event of each busy period is kept.
    One ordered pass per path, newest first; a busy path is split into blocks."""
    after = ordered_scan(
        watched(events), ["path_key"], [F.col("ts").desc(), F.col(tie).desc()], carries={"_next": F.col("ts")}
    )
    quiet = (F.unix_micros(F.col("_next").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000.0
    return after.filter(F.col("_next").isNull() | (quiet >= gap_ms)).drop("_next")


def episodes(events: DataFrame, gap_ms: float, tie: str = "event_id") -> DataFrame:
    """Numbers the busy periods of each path, oldest first."""
    quiet = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_previous").cast("timestamp"))
    return islands(watched(events), ["path_key"], ["ts", tie], "ts", quiet / 1000.0 >= gap_ms, "episode")


def stable_batch(probes: DataFrame, tie: str = "event_id", limit: int = MAX_PROBES) -> DataFrame:
    """Per path and episode the first probe equal to the one before it, among the first
    ``limit``; a probe with a null length (unreadable) breaks the pair.  Only ``limit`` rows
    per episode leave a map task."""
    keys = ["path_key", "episode"]
    early = first_per_key(probes, [F.col(k) for k in keys], ["ts", tie], limit)
    state = F.struct(F.col("length").alias("length"), F.col("modified").alias("modified"))
    paired = ordered_scan(early, keys, ["ts", tie], carries={"_back": F.struct(state.alias("s"))})
    same = F.col("length").isNotNull() & (F.col("_back.s.length") == F.col("length")) & F.col("modified").eqNullSafe(
        F.col("_back.s.modified")
    )
    rest = [c for c in probes.columns if c not in keys]
    return (
        paired.filter(F.coalesce(same, F.lit(False)))
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct("ts", tie)).alias("_r"))
        .select(*keys, "_r.*")
    )


def suppress_repeats_batch(ready: DataFrame, tie: str = "event_id") -> DataFrame:
    """Drops a ready file whose state equals the one signalled before it."""
    seen = ordered_scan(
        ready, ["path_key"], ["ts", tie],
        carries={"_back": F.struct(F.col("length").alias("length"), F.col("modified").alias("modified"))},
    )
    same = F.col("_back").isNotNull() & F.col("_back.length").eqNullSafe(F.col("length")) & F.col(
        "_back.modified"
    ).eqNullSafe(F.col("modified"))
    return seen.filter(~same).drop("_back")


STABLE = T.StructType([
    T.StructField("path_key", T.StringType()),
    T.StructField("episode", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("modified", T.TimestampType()),
])
EVENT = ["us", "tie", "length", "modified_us", "episode"]
SAID = T.StructType([T.StructField("path_key", T.StringType()), *[T.StructField(n, T.LongType()) for n in EVENT]])
_BLOCK = T.StructType([T.StructField("block", T.BinaryType())])
Event = tuple  # as EVENT
Known = tuple | None  # what is remembered of a path


def bucketed(rows: DataFrame, buckets: int) -> GroupedData:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("path_key"), F.lit(buckets))).groupBy("bucket")


def events_of(probes: DataFrame) -> DataFrame:
    """``path_key`` and ``EVENT``; rows without a time are not probes."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    number = lambda c, other: F.col(c) if c in probes.columns else F.lit(other)
    return probes.select(
        "path_key", micros("ts").alias("us"), number("event_id", 0).cast("bigint").alias("tie"), F.col("length").cast("bigint").alias("length"),
        micros("modified").alias("modified_us"), number("episode", None).cast("bigint").alias("episode"),
    ).filter("us is not null")


def load_block(state) -> list[tuple]:
    """The rows that :func:`save_block` put into a value state: a path and its longs."""
    held = state.get()
    if not held:
        return []
    return list(zip(*[c.to_pylist() for c in pa.ipc.open_stream(held[0]).read_all().columns]))


def save_block(state, rows: list[tuple]) -> None:
    if not rows:
        state.clear()
        return
    paths, *longs = zip(*rows)
    columns = [pa.array(paths, pa.string()), *[pa.array(c, pa.int64()) for c in longs]]
    batch = pa.RecordBatch.from_arrays(columns, names=["path_key", *[f"c{i}" for i in range(len(longs))]])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    state.update((sink.getvalue().to_pybytes(),))


def _longs(column: pd.Series) -> list[int | None]:
    if column.dtype == "int64":
        return column.tolist()
    return [None if pd.isna(v) else int(v) for v in column] if column.notna().any() else [None] * len(column)


def by_path(rows: Iterator[pd.DataFrame]) -> dict[str, list[Event]]:
    """The events of each path by time; where the log numbers its events, that decides between equal times."""
    found: dict[str, list[Event]] = {}
    for batch in rows:
        for path, *event in zip(batch["path_key"], *[_longs(batch[n]) for n in EVENT]):
            found.setdefault(path, []).append(tuple(event))
    for events in found.values():
        events.sort(key=lambda e: (e[0], e[1] or 0))
    return found


def said(rows: list[tuple]) -> pd.DataFrame:
    columns = {n: pd.Series([r[i + 1] for r in rows], dtype="Int64") for i, n in enumerate(EVENT)}
    return pd.DataFrame({"path_key": pd.Series([r[0] for r in rows], dtype="object"), **columns})


def set_timer(handle: StatefulProcessorHandle, due: list[int]) -> None:
    """A bucket's timer runs at the first of its paths' times."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    if due:
        handle.registerTimer(min(due))


def walk_stable(rows: list[Event], known: Known, gap: int, limit: int) -> tuple[list[Event], Known]:
    """A path is ready once two probes in a row agree, told once an episode."""
    episode, attempts, length, modified, last, done = known or (0, 0, None, None, None, 0)
    out = []
    for us, tie, size, changed, _ in rows:
        if last is None or us - last >= gap:
            episode, attempts, length, modified, done = episode + 1, 0, None, None, 0
        last, attempts = us, attempts + 1
        if done or attempts > limit:
            continue
        if size is not None and size == length and changed == modified:
            out.append((us, tie, size, changed, episode))
            done = 1
        length, modified = (size, changed) if size is not None else (None, None)
    return out, (episode, attempts, length, modified, last, done)


def walk_repeats(rows: list[Event], known: Known) -> tuple[list[Event], Known]:
    """Passes a ready file on unless it was signalled with the same state before."""
    out = []
    for row in rows:
        if known is None or known != (row[2], row[3]):
            out.append(row)
            known = (row[2], row[3])
    return out, known


class PathBucket(StatefulProcessor):
    """Walks the events of each path of a bucket and keeps one small row per path, all in one block.  The rows of a bucket within
    one micro-batch are sorted together; the source's trigger limit (files or offsets per trigger) bounds them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", _BLOCK)

    def walk(self, rows: list[Event], known: Known) -> tuple[list[Event], Known]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {path: memory for path, *memory in load_block(self.known)}
        out = []
        for path, events in by_path(rows).items():
            told, known[path] = self.walk(events, tuple(known[path]) if path in known else None)
            out += [(path, *e) for e in told]
        save_block(self.known, [(path, *memory) for path, memory in known.items()])
        yield said(out)

    def close(self) -> None:
        pass


class StableFiles(PathBucket):
    """Signals a path once two probes in a row agree."""

    def __init__(self, gap_ms: float, limit: int = MAX_PROBES) -> None:
        self.gap, self.limit = int(gap_ms * 1000), limit

    def walk(self, rows: list[Event], known: Known) -> tuple[list[Event], Known]:
        return walk_stable(rows, known, self.gap, self.limit)


class SuppressRepeats(PathBucket):
    def walk(self, rows: list[Event], known: Known) -> tuple[list[Event], Known]:
        return walk_repeats(rows, known)


BUSY = T.StructType([
    T.StructField("path_key", T.StringType()),
    T.StructField("first_ts", T.TimestampType()),
    T.StructField("last_ts", T.TimestampType()),
    T.StructField("changes", T.LongType()),
    T.StructField("late", T.BooleanType()),
])
_BUSY_ROWS = "path_key string, first_us long, last_us long, changes long, late boolean"


class BusyPeriods(StatefulProcessor):
    """Busy periods of the paths of a bucket.  Kept are those that an event up to ``lateness`` behind the path's newest could still
    reach; they are fired once nothing has come to the path for ``wait``: each path has its time, the bucket a timer for the first of
    them.  An event too old to tell from what was fired, or without a time, comes out as a row of its own, marked late.  Times are
    microseconds; rows are reduced chunk by chunk and never gathered."""

    def __init__(self, gap_ms: float, lateness_ms: float, wait_ms: float) -> None:
        self.gap, self.lateness, self.wait = int(gap_ms * 1000), int(lateness_ms * 1000), int(wait_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _BLOCK)
        self.known = handle.getValueState("known", _BLOCK)

    def merged(self, periods: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for first, last, n in sorted(periods):
            if out and first - out[-1][1] < self.gap:
                out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
            else:
                out.append((first, last, n))
        return out

    def rows(self, periods: list[tuple], late: bool) -> pd.DataFrame:
        at = lambda i: pd.Series([p[i] for p in periods], dtype="Int64")
        return pd.DataFrame({
            "path_key": pd.Series([p[0] for p in periods], dtype="object"), "first_us": at(1), "last_us": at(2),
            "changes": pd.Series([p[3] for p in periods], dtype="int64"), "late": pd.Series([late] * len(periods), dtype="bool"),
        })

    def _run(self, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known = {path: (due, fired) for path, due, fired in load_block(self.known)}
        held: dict[str, list[tuple[int, int, int]]] = {}
        for path, *period in load_block(self.open):
            held.setdefault(path, []).append(tuple(period))
        out, late, came = [], [], set()
        for batch in rows:
            times: dict[str, list[tuple[int, int, int]]] = {}
            for path, us in zip(batch["path_key"], _longs(batch["us"])):
                fired = known[path][1] if path in known else None
                if us is None or (fired is not None and us < fired + self.gap):
                    late.append((path, us, us, 1))
                else:
                    times.setdefault(path, []).append((us, us, 1))
            for path, more in times.items():
                held[path] = self.merged(held.get(path, []) + more)
            came.update(batch["path_key"])
        for path in came & held.keys():
            horizon = max(p[1] for p in held[path]) - self.gap - self.lateness
            done = [p for p in held[path] if p[1] <= horizon]
            held[path] = held[path][len(done):]
            out += [(path, *p) for p in done]
            known[path] = now + self.wait, done[-1][1] if done else known.get(path, (None, None))[1]
        for path in [p for p, (due, _) in known.items() if due is not None and due <= now]:
            done = held.pop(path)
            out += [(path, *p) for p in done]
            known[path] = None, done[-1][1]
        save_block(self.open, [(path, *p) for path, periods in held.items() for p in periods])
        save_block(self.known, [(path, *k) for path, k in known.items()])
        set_timer(self.handle, [due for due, _ in known.values() if due is not None])
        yield self.rows(out, False)
        yield self.rows(late, True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._run(rows, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(iter(()), timerValues)

    def close(self) -> None:
        pass


# The driver-side check of a stateful stream imports nothing shipped with the job, so the
# small processors above travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def debounce_whole_stream(
    events: DataFrame, gap_ms: float = QUIET_SECONDS * 1000, lateness_ms: float = 10_000, wait_ms: float | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Every busy period as ``path_key, first_ts, last_ts, changes, late``; ``changes`` add up to the events read.  A path is
    fired ``wait_ms`` (the gap, if not given) of clock time after its last event came.  Needs the RocksDB state store and a
    trigger that goes on without data, so that timers can run: not ``availableNow``."""
    wait = gap_ms if wait_ms is None else wait_ms
    rows = watched(events).select("path_key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    busy = bucketed(rows, buckets).transformWithStateInPandas(
        BusyPeriods(gap_ms, lateness_ms, wait), _BUSY_ROWS, outputMode="Append", timeMode="ProcessingTime"
    )
    at = lambda c: F.timestamp_micros(f"{c}_us").alias(f"{c}_ts")
    return busy.select("path_key", at("first"), at("last"), "changes", "late")


def run_until_fired(writer, wait_ms: float, limit_s: float = 3600) -> None:
    """Starts ``writer`` and stops it when its input is read and the timers set by the last rows have run."""
    run = writer.trigger(processingTime="0 seconds").start()
    began, last, seen = time.time(), None, -1
    try:
        while True:
            run.awaitTermination(0.1)
            if run.exception() is not None:
                raise run.exception()
            for p in run.recentProgress:
                if p.batchId <= seen:
                    continue
                seen, at = p.batchId, pd.Timestamp(p.timestamp).timestamp()
                if p.numInputRows > 0 or last is None:
                    last = at + p.batchDuration / 1000
                elif at >= last + wait_ms / 1000:  # this batch began after every timer's time and has ended
                    return
            if time.time() - began > limit_s:
                raise TimeoutError(f"the stream did not end within {limit_s} s")
    finally:
        run.stop()


def run_batch(writer, limit_s: float = 3600) -> None:
    """Starts ``writer``, runs one micro-batch and stops before another begins.  It takes all that is there, if the source sets no limit
    per trigger.  Timers due later run after the next start."""
    run = writer.trigger(processingTime="1 day").start()
    began = time.time()
    try:
        while not run.recentProgress:
            run.awaitTermination(0.1)
            if run.exception() is not None:
                raise run.exception()
            if time.time() - began > limit_s:
                raise TimeoutError(f"the micro-batch did not end within {limit_s} s")
    finally:
        run.stop()


def _walked(events: DataFrame, processor: PathBucket, buckets: int) -> DataFrame:
    got = bucketed(events_of(events), buckets).transformWithStateInPandas(processor, SAID, outputMode="Append", timeMode="None")
    return got.select("path_key", "episode", F.timestamp_micros("us").alias("ts"), "length", F.timestamp_micros("modified_us").alias("modified"))


def stable_stream(probes: DataFrame, gap_ms: float, limit: int = MAX_PROBES, buckets: int = BUCKETS) -> DataFrame:
    """Needs the RocksDB state store; ``probes`` has ``path_key, ts, length, modified``."""
    return _walked(probes, StableFiles(gap_ms, limit), buckets)


def suppress_stream(ready: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Needs the RocksDB state store; ``ready`` has the columns of ``STABLE``."""
    return _walked(ready, SuppressRepeats(), buckets)
