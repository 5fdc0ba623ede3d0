"""Streaming operators: their batch twins, and streams run to completion (K)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from assetflow.fixtures import derive, duck
from assetflow.queries.base import query
from assetflow.queries.rules import BASE_SQL, EXT_SQL, FOLDER_SQL, NORM, ROUTE_SQL, SELECT_SQL
from assetflow.session import scratch_path, table
from assetflow.streaming import convert, folder, names, replay, watch

GAP_MS = 12 * 3600 * 1000.0
WAIT_MS = 1000.0  # clock time without events after which a replayed path is fired
PARTITIONS_PER_CORE = 3  # of keyed state
INPUTS = "lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.png', '.gif', '.pdf')"

EPISODE_SQL = f"""
, ev AS (SELECT *, lower(path) AS path_key, CAST(ts AS DATE) AS modified, lag(ts) OVER (PARTITION BY lower(path) ORDER BY ts, event_id) AS back FROM file_events WHERE {INPUTS}),
ep AS (SELECT *, sum(CASE WHEN back IS NULL OR (epoch_us(ts) - epoch_us(back)) / 1000.0::DOUBLE >= {GAP_MS}::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY path_key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode FROM ev),
pr AS (SELECT *, row_number() OVER (PARTITION BY path_key, episode ORDER BY ts, event_id) AS n FROM ep),
la AS (SELECT *, lag(len3) OVER w AS pl, lag(modified) OVER w AS pm FROM (SELECT *, length % 3 AS len3 FROM pr WHERE n <= 12) WINDOW w AS (PARTITION BY path_key, episode ORDER BY ts, event_id)),
st AS (SELECT path_key, CAST(episode AS BIGINT) AS episode, event_id, ts, len3 AS length, modified FROM la WHERE len3 = pl AND modified = pm QUALIFY row_number() OVER (PARTITION BY path_key, episode ORDER BY ts, event_id) = 1)
"""


@query(duck("file_events", f"""
SELECT path_key, event_id, length FROM (SELECT *, lower(path) AS path_key, lead(ts) OVER (PARTITION BY lower(path) ORDER BY ts, event_id) AS nx FROM file_events WHERE {INPUTS})
WHERE nx IS NULL OR (epoch_us(nx) - epoch_us(ts)) / 1000.0::DOUBLE >= {GAP_MS}::DOUBLE"""))
def debounce_events(spark, sf):
    return watch.debounce_batch(derive(spark, sf, "file_events"), GAP_MS).select("path_key", "event_id", "length")


def _probes(spark, sf):
    events = derive(spark, sf, "file_events").withColumns({
        "modified": F.to_date("ts"), "length": F.col("length") % 3,
    })
    return watch.episodes(events, GAP_MS)


@query(duck("file_events", EPISODE_SQL + "SELECT path_key, episode, event_id, length FROM st"))
def stable_files(spark, sf):
    return watch.stable_batch(_probes(spark, sf)).select("path_key", "episode", "event_id", "length")


@query(duck("file_events", EPISODE_SQL + """
SELECT path_key, event_id, length FROM st QUALIFY NOT coalesce(lag(length) OVER (PARTITION BY path_key ORDER BY ts, event_id) = length AND lag(modified) OVER (PARTITION BY path_key ORDER BY ts, event_id) = modified, FALSE)"""))
def suppress_repeats(spark, sf):
    ready = watch.stable_batch(_probes(spark, sf))
    return watch.suppress_repeats_batch(ready).select("path_key", "event_id", "length")


COUNTERS_SQL = duck("work", """
SELECT CAST(l_suppkey % 7 AS BIGINT) AS profile_id, count_if(NOT failed) AS processed, count_if(failed) AS failures, epoch_us(max(finished_at)) AS last_us,
  arg_max(file_name, {'a': finished_at, 'b': file_name, 'c': run_id}) AS last_item FROM work GROUP BY 1""")


@query(COUNTERS_SQL)
def watch_counters(spark, sf):
    work = derive(spark, sf, "work").withColumn("profile_id", (F.col("l_suppkey") % 7).cast("bigint"))
    return convert.watch_counters(work, ties=["file_name", "run_id"]).select(
        "profile_id", "processed", "failures", F.unix_micros(F.col("last_at").cast("timestamp")).alias("last_us"), "last_item"
    )


@query(duck("assets jobs aj", """
SELECT job_id, count(*) AS outputs, count(DISTINCT asset_id) AS inputs FROM (
  SELECT job_id, asset_id, unnest(range(0, CASE
    WHEN is_pdf AND output_format = 'pdf' AND page_count > 1 AND pdf_doc_mode = 'split' THEN page_count WHEN is_pdf AND output_format <> 'pdf' THEN page_count
    WHEN ext = '.gif' AND frame_count > 1 AND output_format NOT IN ('gif', 'pdf') THEN frame_count WHEN ext = '.gif' AND frame_count > 1 AND output_format = 'pdf' THEN frame_count ELSE 1 END)) AS i
  FROM aj WHERE NOT (is_encrypted AND NOT is_unlocked)) GROUP BY job_id"""))
def watch_convert(spark, sf):
    outputs, _ = convert.plan_watched(derive(spark, sf, "assets"), derive(spark, sf, "jobs"))
    return outputs.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("outputs"), F.countDistinct("asset_id").alias("inputs")
    )


def _stream(spark, sf, name):
    """The table as a stream of its parquet file, or of those in its folder.  A stream takes a single file only by a pattern."""
    path = f"{sf.rstrip('/')}/{name}.parque"
    return spark.readStream.schema(spark.read.parquet(f"{path}t").schema).parquet(f"{path}[t]")


def _event_stream(spark, sf):
    raw = _stream(spark, sf, "events")
    return raw.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(
            F.lit("f"), F.col("user_id").cast("string"),
            F.when(F.col("event_type") == "view", ".png").when(F.col("event_type") == "click", ".GIF")
            .when(F.col("event_type") == "error", ".tmp").otherwise(".pdf"),
        ).alias("path"),
    )


@contextmanager
def _rocksdb(spark, by_cores: bool = False):
    """Keyed state with transformWithState needs the RocksDB store; the settings are put back.  ``by_cores``: a state partition costs a Python
    worker and a commit in every micro-batch, however few its rows, so there are as many as keep the cores busy, and a commit stores changes."""
    settings = {"spark.sql.streaming.stateStore.providerClass": watch.ROCKSDB}
    if by_cores:
        parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism)
        settings |= {"spark.sql.shuffle.partitions": str(parts), "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _stored(spark, stream, name: str) -> str:
    """Where the rows of a finished stream are."""
    out = scratch_path(spark, name)
    with _rocksdb(spark, by_cores=True):
        run = (
            stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
            .outputMode("append").trigger(availableNow=True).start()
        )
        run.awaitTermination()
    return f"{out}/rows"


def _finished(spark, stream, name):
    return spark.read.schema(stream.schema).parquet(_stored(spark, stream, name))


@query(duck("file_events", f"""
, ev AS (SELECT lower(path) AS path_key, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY lower(path) ORDER BY ts, event_id))) / 1000.0::DOUBLE AS gap, event_id FROM file_events WHERE {INPUTS}),
g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {GAP_MS}::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY path_key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM ev)
SELECT path_key, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS changes, FALSE AS late FROM g GROUP BY path_key, s"""))
def debounce_whole(spark, sf):
    """Every busy period of the events table replayed as a stream, the last ones too."""
    busy = watch.debounce_whole_stream(_event_stream(spark, sf), GAP_MS, wait_ms=WAIT_MS)
    out = scratch_path(spark, "busy")
    with _rocksdb(spark, by_cores=True):
        watch.run_until_fired(
            busy.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append"), WAIT_MS
        )
    return spark.read.schema(watch.BUSY).parquet(f"{out}/rows").select(
        "path_key", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "changes", "late"
    )


def _probe_stream(spark, sf):
    raw = _stream(spark, sf, "events")
    suffix = (
        F.when(F.col("event_type") == "view", ".png").when(F.col("event_type") == "click", ".GIF")
        .when(F.col("event_type") == "error", ".tmp").otherwise(".pdf")
    )
    return watch.watched(raw.select(
        "event_id", F.concat(F.lit("f"), F.col("user_id").cast("string"), suffix).alias("path"), F.col("ts").cast("timestamp").alias("ts"),
        (F.floor(F.col("value") / 100) % 3).cast("bigint").alias("length"), F.to_date("ts").cast("timestamp").alias("modified"),
    ))


@query(duck("file_events", EPISODE_SQL + "SELECT path_key, episode, epoch_us(ts) AS ts_us, length FROM st"))
def stable_stream(spark, sf):
    """The probes replayed as a stream through keyed state."""
    ready = _finished(spark, watch.stable_stream(_probe_stream(spark, sf), GAP_MS), "stable")
    return ready.select("path_key", "episode", F.unix_micros("ts").alias("ts_us"), "length")


@query(duck("file_events", EPISODE_SQL + """
SELECT path_key, epoch_us(ts) AS ts_us, length FROM st QUALIFY NOT coalesce(lag(length) OVER (PARTITION BY path_key ORDER BY ts, event_id) = length AND lag(modified) OVER (PARTITION BY path_key ORDER BY ts, event_id) = modified, FALSE)"""))
def suppress_stream(spark, sf):
    """Ready files stored by one stream and signalled by the next."""
    out = _stored(spark, watch.stable_stream(_probe_stream(spark, sf), GAP_MS), "stable")
    ready = spark.readStream.schema(watch.STABLE).parquet(out)
    return _finished(spark, watch.suppress_stream(ready), "signals").select("path_key", F.unix_micros("ts").alias("ts_us"), "length")


def _change_files(rows, root: str) -> None:
    """Writes, moves and deletes files below ``root``, as rows of (name, size, moved_from) say: a null size deletes."""

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                path = f"{base}/{r['name']}"
                if r["moved_from"] is not None:
                    system.move(f"{base}/{r['moved_from']}", path)
                elif r["size"] is None:
                    system.delete_file(path)
                else:
                    with system.open_output_stream(path) as out:
                        out.write(b"x" * r["size"])
            yield batch.select(["name"])

    rows.mapInArrow(change, "name string").write.format("noop").mode("overwrite").save()


@query("""
WITH f AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.GIF' WHEN 2 THEN '.pdf' ELSE '.txt' END AS ext FROM supplier)
SELECT listing, name, length FROM (
  SELECT 0::BIGINT AS listing, 'f' || k || ext AS name, (10 + k % 7)::BIGINT AS length, ext FROM f
  UNION ALL SELECT 1, CASE WHEN k % 5 = 0 THEN 'f' ELSE 'r' END || k || ext, 10 + k % 7 + CASE WHEN k % 5 = 0 THEN 100 ELSE 0 END, ext FROM f WHERE k % 5 < 2
  UNION ALL SELECT 2, 'n' || k || ext, 5, ext FROM f WHERE k % 7 = 1) WHERE ext <> '.txt'""")
def watch_folder(spark, sf):
    """A folder with a file for each supplier, listed three times by a stream that is started anew each time: new, rewritten and renamed files."""
    out = scratch_path(spark, "watched")
    root = out if "://" in out or out.startswith("file:") else f"file://{out}"
    k = F.col("s_suppkey")
    ext = F.when(k % 4 == 0, ".png").when(k % 4 == 1, ".GIF").when(k % 4 == 2, ".pdf").otherwise(".txt")
    name = lambda letter: F.concat(F.lit(letter), k.cast("string"), ext)
    kept, size = F.when(k % 5 == 1, name("r")).otherwise(name("f")), (10 + k % 7).cast("bigint")
    files, none = table(spark, sf, "supplier"), F.lit(None)
    row = lambda n, s, m: (n.alias("name"), s.cast("bigint").alias("size"), m.cast("string").alias("moved_from"))
    rounds = [
        [files.select(*row(name("f"), size, none))],
        [files.filter(k % 5 == 0).select(*row(name("f"), size + 100, none)), files.filter(k % 5 == 1).select(*row(name("r"), size, name("f")))],
        [files.filter(k % 7 == 0).select(*row(kept, none, none)), files.filter(k % 7 == 1).select(*row(name("n"), F.lit(5), none))],
    ]
    for changes in rounds:
        for rows in changes:
            _change_files(rows, f"{root}/in")
        seen = folder.watch_folder(spark, f"{root}/in", f"{root}/listings")
        keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/rows/listing={n}")
        seen.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("path string, length bigint, listing bigint").parquet(f"{out}/rows")
    return found.select("listing", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length")


WATCHED_SQL = "WITH RECURSIVE " + duck("assets jobs overrides", NORM + """
, wj AS (SELECT * REPLACE (CASE WHEN frame_count > 1 AND output_format <> 'gif' THEN 'all' ELSE gif_mode END AS gif_mode,
    CASE WHEN is_pdf AND page_count > 1 AND output_format <> 'pdf' THEN 'all_pages' ELSE pdf_image_mode END AS pdf_image_mode, 'specific' AS folder_rule) FROM naj)
""" + SELECT_SQL.replace("FROM naj LEFT JOIN ov ON naj.job_id = ov.job_id AND lower(naj.path) = ov.k", "FROM wj AS naj LEFT JOIN ov ON FALSE") + ROUTE_SQL).removeprefix("WITH ") + f"""
, named AS (SELECT asset_id, job_id, page_count, frame_count, strategy, allow_overwrite, (asset_id % 3) * 1000000000000 + asset_id AS seq, {FOLDER_SQL} AS folder, {BASE_SQL} AS base_name,
    CASE WHEN strategy IN ('pdf_split','pdf_pages','gif_pdf_frames','gif_specific_pdf','gif_frames') THEN '' ELSE {EXT_SQL} END AS ext_out
  FROM (SELECT *, 0 AS batch_index FROM rt) WHERE NOT (is_encrypted AND NOT is_unlocked))
, items AS (SELECT *, allow_overwrite AND ext_out <> '' AS over, lower(folder) AS f, lower(base_name) AS b, lower(ext_out) AS x, regexp_replace(lower(base_name), '(\\([1-9][0-9]*\\))+$', '') AS root FROM named)
, grouped AS (SELECT *, dense_rank() OVER (ORDER BY f, x, root) AS gid, row_number() OVER (PARTITION BY f, x, root ORDER BY seq) AS i FROM items)
, walk AS (SELECT DISTINCT gid, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS BIGINT) AS asset_id, CAST(NULL AS BIGINT) AS slot FROM grouped
  UNION ALL
  SELECT gid, i, list_append(taken, b || CASE WHEN slot > 0 THEN '(' || slot || ')' ELSE '' END), asset_id, slot FROM (
    SELECT w.gid, g.i, w.taken, g.asset_id, g.b, CASE WHEN g.over THEN 0 ELSE list_filter(range(0, g.i + 2), lambda k: NOT list_contains(w.taken, g.b || CASE WHEN k > 0 THEN '(' || k || ')' ELSE '' END))[1] END AS slot
    FROM walk w JOIN grouped g ON g.gid = w.gid AND g.i = w.i + 1))
SELECT n.asset_id % 3 AS batch, n.asset_id, n.job_id, (o.i + 1)::BIGINT AS output_no, n.folder || '/' || n.base_name || CASE WHEN w.slot > 0 THEN '(' || w.slot || ')' ELSE '' END || n.ext_out AS destination
FROM named n JOIN walk w ON w.asset_id = n.asset_id,
  (SELECT unnest(range(0, 2000)) AS i) o WHERE o.i < CASE WHEN strategy IN ('pdf_split','pdf_pages') THEN greatest(page_count, 1) WHEN strategy IN ('gif_pdf_frames','gif_frames') THEN greatest(frame_count, 1) ELSE 1 END"""


@query(COUNTERS_SQL)
def watch_counters_stream(spark, sf):
    """The counters after three micro-batches in update mode, each of which wrote the profiles it changed."""
    out = scratch_path(spark, "counters")
    work = derive(spark, sf, "work").withColumn("profile_id", (F.col("l_suppkey") % 7).cast("bigint"))
    for n in range(3):  # started anew for each micro-batch, which many tasks write and read
        work.filter(F.col("item_no") % 3 == n).write.mode("append").parquet(f"{out}/in")
        counters = convert.watch_counters(spark.readStream.schema(work.schema).parquet(f"{out}/in"), ties=["file_name", "run_id"])
        writer = counters.writeStream.outputMode("update").foreachBatch(convert.counters_writer(f"{out}/out"))
        writer.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    kinds = ", ".join(f"{c} {t}" for c, t in counters.dtypes)
    return convert.current_counters(spark, f"{out}/out", kinds).select(
        "profile_id", "processed", "failures", F.unix_micros(F.col("last_at").cast("timestamp")).alias("last_us"), "last_item"
    )


@query(WATCHED_SQL)
def watch_convert_stream(spark, sf):
    """Ready files in three micro-batches, each planned with its profile; names given by earlier batches are taken."""
    out = scratch_path(spark, "converted")
    assets = derive(spark, sf, "assets")
    for n in range(3):
        assets.filter(F.col("asset_id") % 3 == n).write.mode("append").parquet(f"{out}/in")
        ready = spark.readStream.schema(assets.schema).parquet(f"{out}/in")
        with _rocksdb(spark):
            writer = names.named_stream(ready, derive(spark, sf, "jobs")).writeStream.foreachBatch(names.named_writer(f"{out}/out"))
            writer.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    kinds = "job_id bigint, asset_id bigint, output_no bigint, destination string, batch bigint"
    return spark.read.schema(kinds).parquet(f"{out}/out/outputs").select("batch", "asset_id", "job_id", "output_no", "destination")


# Events of the table come in any order: each micro-batch holds some of every time.  So all wait for an event of each path that is
# later by more than the lateness, which ends the log; no timer is needed.
FAR_MS, DAY_MS, END = 30 * 365.25 * 86_400_000, 86_400_000.0, "TIMESTAMP '2100-01-01'"


def _shuffled(spark, rows, through, label: str):
    """What ``through`` says of a table as a stream of four micro-batches, started anew for each: three have every third event of the log, the
    last one ends each path.  A micro-batch is written and read by many tasks; the timers are a day off."""
    out = scratch_path(spark, label)
    ended = rows.groupBy("path_key").agg(F.expr(END).alias("ts"))
    ends = ended.select(*[F.col(f.name) if f.name in ended.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    for part in [*[rows.filter(F.col("event_id") % 3 == n) for n in (2, 0, 1)], ends]:
        part.write.mode("append").parquet(f"{out}/in")
        stream = through(spark.readStream.schema(rows.schema).parquet(f"{out}/in"))
        with _rocksdb(spark, by_cores=True):
            watch.run_batch(stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append"))
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _stable_in_order(spark, sf):
    events = derive(spark, sf, "file_events").withColumns({"modified": F.to_date("ts").cast("timestamp"), "length": F.col("length") % 3, "ts": F.col("ts").cast("timestamp")})
    probes = watch.watched(events).select("path_key", "event_id", "ts", "length", "modified")
    return _shuffled(spark, probes, lambda stream: replay.stable_in_order(stream, GAP_MS, FAR_MS, DAY_MS), "stable")


@query(duck("file_events", EPISODE_SQL + "SELECT path_key, episode, event_id, length FROM st"))
def stable_in_order(spark, sf):
    """The probes in three micro-batches out of order, through keyed state that waits for what is late."""
    return _stable_in_order(spark, sf).select("path_key", "episode", "event_id", "length")


@query(duck("file_events", EPISODE_SQL + """
SELECT path_key, event_id, length FROM st QUALIFY NOT coalesce(lag(length) OVER (PARTITION BY path_key ORDER BY ts, event_id) = length AND lag(modified) OVER (PARTITION BY path_key ORDER BY ts, event_id) = modified, FALSE)"""))
def repeats_in_order(spark, sf):
    """Ready files in three micro-batches out of order."""
    ready = _stable_in_order(spark, sf)
    return _shuffled(spark, ready, lambda stream: replay.repeats_in_order(stream, FAR_MS, DAY_MS), "signals").select("path_key", "event_id", "length")
