"""Streams run to completion against their batch twins."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.cloudpickle import cloudpickle

from assetflow.queries import watching
from assetflow.streaming import convert, folder, names, replay, watch
from tests.test_sources import ASSET_COLUMNS, ASSETS, job

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).replace(tzinfo=None)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def finish(stream, tmp_path, name, mode="append"):
    out, state = str(tmp_path / name), str(tmp_path / f"{name}-state")
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)


@pytest.fixture
def probes(spark, tmp_path):
    rows = [
        ("/w/a.png", 0, 10), ("/w/a.png", 1, 20), ("/w/a.png", 2, 20), ("/w/a.png", 3, 20),  # ready at 2
        ("/w/b.png", 0, 5), ("/w/b.png", 1, None), ("/w/b.png", 2, 5), ("/w/b.png", 3, 5),  # the gap resets, ready at 3
        ("/w/A.PNG", 50, 20), ("/w/a.png", 51, 20),  # ready again, same state
        ("/w/a.png", 100, 30), ("/w/a.png", 101, 30),  # ready again, changed
        ("/w/c.txt", 0, 1), ("/w/c.txt", 1, 1),
    ]
    data = [(i, p, at(s), n, START) for i, (p, s, n) in enumerate(rows)]
    df = spark.createDataFrame(data, "event_id long, path string, ts timestamp, length long, modified timestamp")
    folder = str(tmp_path / "events")
    df.coalesce(1).write.parquet(folder)
    return df, spark.readStream.schema(df.schema).parquet(folder)


def pick(df):
    return sorted((r.path_key, (r.ts - START).total_seconds(), r.length) for r in df.collect())


READY = [("/w/a.png", 2.0, 20), ("/w/a.png", 51.0, 20), ("/w/a.png", 101.0, 30), ("/w/b.png", 3.0, 5)]


def test_stable_files(spark, probes, tmp_path):
    batch, stream = probes
    assert pick(watch.stable_batch(watch.episodes(batch, 10_000))) == READY
    streamed = finish(watch.stable_stream(watch.watched(stream), 10_000), tmp_path, "stable")
    assert pick(streamed) == READY


def test_repeats(spark, probes, tmp_path):
    want = [r for r in READY if r[1] != 51.0]
    ready = watch.stable_batch(watch.episodes(probes[0], 10_000))
    assert pick(watch.suppress_repeats_batch(ready)) == want
    folder = str(tmp_path / "ready")
    ready.select("path_key", "episode", "ts", "length", "modified").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    assert pick(finish(watch.suppress_stream(stream), tmp_path, "signals")) == want


def test_probe_limit(spark):
    data = [(i, "/w/a.png", at(i), i if i < 12 else 99, START) for i in range(16)]
    df = spark.createDataFrame(data, "event_id long, path string, ts timestamp, length long, modified timestamp")
    assert watch.stable_batch(watch.episodes(df, 10_000)).count() == 0
    assert watch.stable_batch(watch.episodes(df, 10_000), limit=14).count() == 1


def test_debounce(spark, tmp_path, small_groups):
    rows = [("/w/a.png", s) for s in (0, 1, 1.9, 10, 11, 13)] + [("/w/b.gif", 0), ("/w/c.tmp", 0), ("/w/z.png", 100)]
    df = spark.createDataFrame([(i, p, at(s)) for i, (p, s) in enumerate(rows)], "event_id long, path string, ts timestamp")
    kept = watch.debounce_batch(df, 1200)
    assert sorted((r.path, (r.ts - START).total_seconds()) for r in kept.collect()) == [
        ("/w/a.png", 1.9), ("/w/a.png", 11.0), ("/w/a.png", 13.0), ("/w/b.gif", 0.0), ("/w/z.png", 100.0),
    ]
    folder = str(tmp_path / "events")
    df.coalesce(1).write.parquet(folder)
    stream = watch.debounce_stream(spark.readStream.schema(df.schema).parquet(folder))
    got = finish(stream, tmp_path, "quiet")
    # the newest path is still open when the input ends
    assert sorted((r.path_key, (r.last_ts - START).total_seconds(), r.changes) for r in got.collect()) == [
        ("/w/a.png", 1.9, 3), ("/w/a.png", 11.0, 2), ("/w/a.png", 13.0, 1), ("/w/b.gif", 0.0, 1),
    ]


def test_debounce_whole_loses_nothing(spark, tmp_path):
    schema, folder = "event_id long, path string, ts timestamp", str(tmp_path / "events")

    def feed(rows, mode="append"):
        spark.createDataFrame([(i, p, at(s)) for i, (p, s) in enumerate(rows)], schema).coalesce(1).write.mode(mode).parquet(folder)
        busy = watch.debounce_whole_stream(spark.readStream.schema(schema).parquet(folder), wait_ms=500)
        writer = busy.writeStream.format("parquet").option("path", str(tmp_path / "busy")).option("checkpointLocation", str(tmp_path / "state"))
        watch.run_until_fired(writer.outputMode("append"), 500, 300)
        found = spark.read.schema(watch.BUSY).parquet(str(tmp_path / "busy")).collect()
        return sorted((r.path_key, (r.first_ts - START).total_seconds(), (r.last_ts - START).total_seconds(), r.changes, r.late) for r in found)

    first = [("/w/a.png", 13, 13, 1, False), ("/w/a.png", 0, 1.9, 3, False), ("/w/a.png", 10, 11, 2, False), ("/w/b.gif", 0, 0, 1, False), ("/w/z.png", 100, 100, 1, False)]
    # out of order within a batch; the newest period of every path is fired by its timer
    got = feed([("/w/a.png", s) for s in (13, 0, 1.9, 11, 10, 1)] + [("/w/b.gif", 0), ("/w/c.tmp", 0), ("/w/z.png", 100)])
    assert got == sorted(first)
    # an event behind what was fired is told as late, one after it is a new period
    assert feed([("/w/a.png", 12), ("/w/a.png", 30), ("/w/z.png", 40)]) == sorted(
        first + [("/w/a.png", 12, 12, 1, True), ("/w/a.png", 30, 30, 1, False), ("/w/z.png", 40, 40, 1, True)]
    )


def test_watch_source_reads_names_only(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "a.PNG").write_bytes(b"1234")
    (root / "b.txt").write_bytes(b"1")
    got = finish(watch.watch_source(spark, str(root)), tmp_path, "seen").collect()
    assert [(r.path_key.rsplit("/", 1)[1], r.length) for r in got] == [("a.png", 4)]


def test_converter_is_idempotent(spark, tmp_path):
    assets = spark.createDataFrame(ASSETS, ASSET_COLUMNS)
    handle = convert.converter(spark.createDataFrame([job(1, gif_mode="first"), job(2)]), str(tmp_path))
    handle(assets, 7)
    handle(assets, 7)
    outputs = spark.read.parquet(str(tmp_path / "outputs"))
    assert sorted((r.asset_id, r.output_no) for r in outputs.collect()) == [(1, 1), (2, 1), (4, 1), (5, 1), (5, 2), (5, 3), (5, 4), (6, 1)]
    history = {r.job_id: (r.total_count, r.failure_count) for r in spark.read.parquet(str(tmp_path / "history")).collect()}
    assert history == {1: (5, 1), 2: (1, 0)}
    assert [r.file_name for r in spark.read.parquet(str(tmp_path / "failures")).collect()] == ["b.pdf"]


def test_converter_names_do_not_depend_on_batches(spark, tmp_path):
    assets = spark.createDataFrame(ASSETS, ASSET_COLUMNS).filter("asset_id = 1")
    for mode, names in (("keep", ["a.png", "a(1).png", "a(2).png"]), ("number", ["01.png", "01(1).png", "01(2).png"])):
        root = str(tmp_path / mode)
        held = spark.createDataFrame([("/out", names[0])], "folder string, file_name string")
        handle = convert.converter(spark.createDataFrame([job(1, rename_mode=mode)]), root, lambda h=held: h.filter("false"))
        for batch in range(3):
            handle(assets, batch)
        handle(assets, 2)  # a repeated batch gets the same name
        found = spark.read.parquet(f"{root}/outputs").orderBy("batch").collect()
        assert [r.destination for r in found] == [f"/out/{n}" for n in names]
    after = str(tmp_path / "existing")
    convert.converter(spark.createDataFrame([job(1)]), after, lambda: spark.createDataFrame([("/out", "A.png")], "folder string, file_name string"))(assets, 0)
    assert spark.read.parquet(f"{after}/outputs").first().destination == "/out/a(1).png"


def test_counters_stream(spark, tmp_path):
    df = spark.createDataFrame(
        [("p", False, at(1), "a.png"), ("p", True, at(2), "b.png"), ("q", False, at(0), "c.png")],
        "profile_id string, failed boolean, finished_at timestamp, file_name string",
    )
    folder = str(tmp_path / "outcomes")
    df.write.parquet(folder)
    stream = convert.watch_counters(spark.readStream.schema(df.schema).parquet(folder))
    query = stream.writeStream.format("memory").queryName("counters").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = sorted(map(tuple, spark.sql("select profile_id, processed, failures, last_item from counters").collect()))
    assert rows == [("p", 1, 1, "b.png"), ("q", 1, 0, "c.png")]
    assert rows == sorted(map(tuple, convert.watch_counters(df).drop("last_at").collect()))


def test_folder_source_sees_changed_and_renamed_files(spark, tmp_path):
    root, state = tmp_path / "in", str(tmp_path / "listings")
    (root / "sub").mkdir(parents=True)
    seen = []

    def run(**options):
        stream = folder.watch_folder(spark, str(root), state, shards=3, **options)
        keep = lambda batch, n: seen.extend((n, r.path_key.rsplit("/", 1)[1], r.length) for r in batch.collect())
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        new, seen[:] = sorted(seen), []
        return new

    (root / "a.png").write_bytes(b"1234")
    (root / "sub" / "b.GIF").write_bytes(b"1")
    (root / "c.txt").write_bytes(b"1")
    assert run() == [(0, "a.png", 4), (0, "b.gif", 1)]
    assert run() == []  # nothing has changed
    (root / "a.png").write_bytes(b"4321")  # as long as before
    os.utime(root / "a.png", (1, 1))
    (root / "sub" / "b.GIF").rename(root / "d.gif")
    (root / "c.txt").unlink()
    assert [x[1:] for x in run()] == [("a.png", 4), ("d.gif", 1)]
    (root / "d.gif").rename(root / "a.png")  # onto a known name
    assert [x[1:] for x in run()] == [("a.png", 1)]
    kept = sorted(p.name for p in (tmp_path / "listings").iterdir())
    assert 1 <= len(kept) <= 2  # older listings go


def test_folder_source_can_leave_out_what_is_there(spark, tmp_path):
    reader = lambda **o: folder.FolderReader({"path": str(tmp_path / "in"), "state": str(tmp_path / "s"), **o})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"1")
    first = reader(existing="false")
    start = first.initialOffset()
    assert start == {"listing": 1} and first.latestOffset() == start
    (tmp_path / "in" / "b.png").write_bytes(b"12")
    end = reader().latestOffset()  # another process
    rows = [r for p in first.partitions(start, end) for b in first.read(p) for r in b.to_pylist()]
    assert [(r["path"].rsplit("/", 1)[1], r["length"]) for r in rows] == [("b.png", 2)]
    again = [r for p in first.partitions(start, end) for b in first.read(p) for r in b.to_pylist()]
    assert again == rows  # a batch may be repeated
    assert [r for p in first.partitions({"listing": 0}, start) for b in first.read(p) for r in b.to_pylist()][0]["path"].endswith("a.png")


def test_names_are_kept_between_batches(spark, tmp_path):
    base = spark.createDataFrame(ASSETS, ASSET_COLUMNS)
    profiles = spark.createDataFrame([job(1), job(2, allow_overwrite=True)])
    source, out = str(tmp_path / "ready"), str(tmp_path / "out")
    held = spark.createDataFrame([("/out", "A.png"), ("/OUT/", "a(2).PNG")], "folder string, file_name string")

    def feed(rows):
        rows.coalesce(1).write.mode("append").parquet(source)
        ready = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream = names.named_stream(ready, profiles, held)
        writer = stream.writeStream.foreachBatch(names.named_writer(out)).option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.batch, r.asset_id, r.destination) for r in spark.read.parquet(f"{out}/outputs").collect())

    one = base.filter("asset_id = 1")
    twice = one.unionByName(one.selectExpr("10L as asset_id", *one.columns[1:]))
    first = [(0, 1, "/out/a(1).png"), (0, 10, "/out/a(3).png")]
    assert feed(twice) == first
    renamed = one.selectExpr("11L as asset_id", "job_id", *[f"'/in/a(4).png' as {c}" if c == "path" else c for c in one.columns[2:]])
    second = [(1, 11, "/out/a(4).png")]
    assert feed(renamed) == first + second
    assert feed(one) == first + second + [(2, 1, "/out/a(5).png")]  # the query was started anew
    locked = base.filter("is_pdf and is_encrypted and not is_unlocked")
    assert locked.count() > 0 and len(feed(locked)) == 4
    assert spark.read.parquet(f"{out}/failures").count() == locked.count()


def test_state_in_order_and_ended(spark, probes, tmp_path):
    batch, _ = probes
    rows, source = watch.watched(batch), str(tmp_path / "log")
    for n in (1, 2, 0):  # three micro-batches, each with some of every time
        rows.filter(f"event_id % 3 = {n}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    state, out = str(tmp_path / "state"), str(tmp_path / "rows")

    def run(ttl):
        ready = replay.stable_in_order(stream, 10_000, 1_000_000, 500, ttl)
        writer = ready.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append")
        watch.run_until_fired(writer, 500 + ttl, 300)
        return spark.read.schema(ready.schema).parquet(out)

    assert pick(run(300)) == READY
    held = spark.read.format("statestore").option("path", state).option("stateVarName", "known").load()
    assert held.count() == 0  # every path was idle for its time
    # an old row: nothing is known any more, so it begins anew
    rows.filter("event_id in (2, 3)").coalesce(1).write.mode("append").parquet(source)
    assert pick(run(300)) == sorted([*READY, ("/w/a.png", 3.0, 20)])


def test_late_rows_are_told(spark, tmp_path):
    source = str(tmp_path / "log")
    schema = "event_id long, path_key string, ts timestamp, length long, modified timestamp"
    feed = lambda *rows: spark.createDataFrame([(i, "a", at(s), n, START) for i, s, n in rows], schema).coalesce(1).write.mode("append").parquet(source)
    feed((0, 0, 5), (5, 60, 5), (1, 100, 5), (2, 101, 5))
    feed((3, 50, 5), (4, 96, 5))  # the first is behind what was walked
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    ready = replay.stable_in_order(stream, 10_000, 20_000, 400, 10_000)
    out = str(tmp_path / "rows")
    writer = ready.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append")
    watch.run_until_fired(writer, 400, 300)
    got = sorted(((r.ts - START).total_seconds(), r.episode) for r in spark.read.schema(ready.schema).parquet(out).collect())
    assert got == [(50.0, None), (100.0, 3)]


def test_counters_written_again_change_nothing(spark, tmp_path):
    kinds, write = "profile_id bigint, processed bigint", convert.counters_writer(str(tmp_path / "c"))
    for n, rows in ((0, [(1, 2), (2, 1)]), (1, [(1, 5)]), (1, [(1, 5)])):
        write(spark.createDataFrame(rows, kinds), n)
    assert sorted(map(tuple, convert.current_counters(spark, str(tmp_path / "c"), kinds).collect())) == [(1, 5), (2, 1)]


def state_rows(spark, state, name="known"):
    return spark.read.format("statestore").option("path", state).option("stateVarName", name).load().count()


def test_repeats_in_order_share_keys_and_files(spark, probes, tmp_path, monkeypatch):
    monkeypatch.setattr(watching, "scratch_path", lambda spark, label: str(tmp_path / label))
    rows = watch.watched(probes[0]).select("path_key", "event_id", "ts", "length", "modified").repartition(4)
    through = lambda stream: replay.repeats_in_order(stream, watching.FAR_MS, watching.DAY_MS, buckets=1)
    got = watching._shuffled(spark, rows, through, "signals")
    assert pick(got.filter("path_key like '%a.png'")) == [("/w/a.png", 0.0, 10), ("/w/a.png", 1.0, 20), ("/w/a.png", 100.0, 30)]
    assert state_rows(spark, str(tmp_path / "signals" / "state")) == 1  # two paths
    assert len(list((tmp_path / "signals" / "in").glob("*.parquet"))) > 4  # four micro-batches, none of one file


def test_counters_stream_spreads_its_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(watching, "scratch_path", lambda spark, label: str(tmp_path / label))
    lines = spark.range(60).selectExpr(
        "id as l_orderkey", "int(id % 3) as l_linenumber", "id as l_partkey", "id % 2 as l_suppkey", "'R' as l_returnflag", "timestamp'2024-01-01' as l_shipdate",
        "1d as l_quantity", "1d as l_extendedprice", "1d as l_discount", "1d as l_tax", "'F' as l_linestatus",
    )
    lines.repartition(4).write.parquet(str(tmp_path / "sf" / "lineitem.parquet"))
    got = watching.watch_counters_stream(spark, str(tmp_path / "sf"))
    assert sorted((r.profile_id, r.processed, r.failures) for r in got.collect()) == [(0, 0, 30), (1, 0, 30)]
    assert len(list((tmp_path / "counters" / "in").glob("*.parquet"))) > 3  # three micro-batches, none of one file
    assert sorted(p.name for p in (tmp_path / "counters" / "out").glob("batch=*")) == ["batch=0", "batch=1", "batch=2"]


def test_stable_and_repeats_share_keys(spark, probes, tmp_path):
    stable = finish(watch.stable_stream(watch.watched(probes[1]), 10_000, buckets=1), tmp_path, "stable")
    assert pick(stable) == READY
    assert state_rows(spark, str(tmp_path / "stable-state")) == 1  # two paths
    signals = finish(watch.suppress_stream(spark.readStream.schema(watch.STABLE).parquet(str(tmp_path / "stable")), buckets=1), tmp_path, "signals")
    assert pick(signals) == [r for r in READY if r[1] != 51.0]
    assert state_rows(spark, str(tmp_path / "signals-state")) == 1


def test_paths_of_a_key_have_their_own_times(spark, tmp_path):
    schema, source = "event_id long, path string, ts timestamp", str(tmp_path / "events")

    def feed(*rows):
        spark.createDataFrame([(i, p, at(s)) for i, (p, s) in enumerate(rows)], schema).coalesce(1).write.mode("append").parquet(source)
        busy = watch.debounce_whole_stream(spark.readStream.schema(schema).parquet(source), wait_ms=500, buckets=1)
        writer = busy.writeStream.format("parquet").option("path", str(tmp_path / "busy")).option("checkpointLocation", str(tmp_path / "state"))
        watch.run_until_fired(writer.outputMode("append"), 500, 300)
        found = spark.read.schema(watch.BUSY).parquet(str(tmp_path / "busy")).collect()
        return sorted((r.path_key, (r.first_ts - START).total_seconds(), r.changes, r.late) for r in found)

    assert feed(("/a.png", 0), ("/a.png", 1), ("/b.png", 5)) == [("/a.png", 0.0, 2, False), ("/b.png", 5.0, 1, False)]
    # the key has a fired path and one with something open
    assert feed(("/b.png", 4), ("/c.png", 9))[1:] == [("/b.png", 4.0, 1, True), ("/b.png", 5.0, 1, False), ("/c.png", 9.0, 1, False)]
    assert state_rows(spark, str(tmp_path / "state")) == 1 and state_rows(spark, str(tmp_path / "state"), "open") == 0


def test_stable_in_order_shares_keys(spark, probes, tmp_path, monkeypatch):
    monkeypatch.setattr(watching, "scratch_path", lambda spark, label: str(tmp_path / label))
    rows = watch.watched(probes[0]).select("path_key", "event_id", "ts", "length", "modified")
    through = lambda stream: replay.stable_in_order(stream, 10_000, watching.FAR_MS, watching.DAY_MS, buckets=1)
    assert pick(watching._shuffled(spark, rows, through, "stable")) == READY
    assert state_rows(spark, str(tmp_path / "stable" / "state")) == 1


def test_state_partitions_go_by_cores(spark, probes, tmp_path, monkeypatch):
    monkeypatch.setattr(watching, "scratch_path", lambda spark, label: str(tmp_path / label))
    rows = watch.watched(probes[0]).select("path_key", "event_id", "ts", "length", "modified")
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(10 * cores))
    try:
        got = watching._shuffled(spark, rows, lambda stream: replay.stable_in_order(stream, 10_000, watching.FAR_MS, watching.DAY_MS), "stable")
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(10 * cores)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert pick(got) == READY
    assert spark.read.format("state-metadata").load(str(tmp_path / "stable" / "state")).first().numPartitions == 3 * cores
    # four starts, one micro-batch each: none without rows, none begun anew
    commits = (tmp_path / "stable" / "state" / "commits").iterdir()
    assert sorted(int(p.name) for p in commits if p.name.isdigit()) == [0, 1, 2, 3]


SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def many_partitions(spark, tmp_path, monkeypatch):
    """More shuffle partitions than the cores can use; scratch folders below ``tmp_path``."""
    monkeypatch.setattr(watching, "scratch_path", lambda spark, label: str(tmp_path / label))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(10 * spark.sparkContext.defaultParallelism))
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def per_core(spark, state):
    found = spark.read.format("state-metadata").load(str(state)).first()
    return found.numPartitions / spark.sparkContext.defaultParallelism


def test_suppress_stream_reads_what_was_stored(spark, tmp_path, many_partitions):
    assert watching.suppress_stream(spark, SMALL).count() > 0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["signals", "stable"]  # no copy between the streams
    assert per_core(spark, tmp_path / "signals" / "state") == per_core(spark, tmp_path / "stable" / "state") == 3


def test_stable_stream_partitions(spark, tmp_path, many_partitions):
    assert watching.stable_stream(spark, SMALL).count() > 0
    assert per_core(spark, tmp_path / "stable" / "state") == 3


def test_debounce_whole_partitions(spark, tmp_path, many_partitions):
    assert watching.debounce_whole(spark, SMALL).count() > 0
    assert per_core(spark, tmp_path / "busy" / "state") == 3


def test_streamed_tables_may_be_folders(spark, tmp_path):
    rows = spark.read.parquet(f"{SMALL}/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "sf" / "events.parquet"))
    for n, folder in enumerate((SMALL, str(tmp_path / "sf"))):
        stream = watching._stream(spark, folder, "events")
        assert finish(stream, tmp_path, f"rows{n}").count() == rows.count()


def test_processors_travel_by_value(tmp_path):
    processors = [replay.StableInOrder(1, 2, 3, 4, 5), replay.RepeatsInOrder(3, 4, 5), watch.StableFiles(1), watch.SuppressRepeats(), watch.BusyPeriods(1, 2, 3)]
    load = "import sys; from pyspark.cloudpickle import cloudpickle; cloudpickle.loads(sys.stdin.buffer.read())"
    elsewhere = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # the package cannot be imported there
    for p in processors:
        subprocess.run([sys.executable, "-c", load], input=cloudpickle.dumps(p), cwd=tmp_path, env=elsewhere, check=True)
