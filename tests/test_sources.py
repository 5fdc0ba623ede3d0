"""Files: listing, headers, rasters, history, presets, logs and plans on storage."""

from __future__ import annotations

import struct
import zlib
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from assetflow.functions import display
from assetflow.plans import conversion, runs
from assetflow.sources import failure_log, headers, history, plan_sink, presets, rasters, scan
from assetflow.schemas import PRESET_DEFAULTS


def png(width, height, pixels=None, color=6):
    def chunk(tag, body):
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    rows = b"".join(b"\0" + bytes(sum(pixels[y * width:(y + 1) * width], [])) for y in range(height)) if pixels else b""
    head = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    (root / "sub").mkdir(parents=True)
    (root / "a.png").write_bytes(png(2, 1, [[10, 20, 30, 255], [40, 50, 60, 0]]))
    (root / "b.GIF").write_bytes(b"GIF89a" + struct.pack("<HH", 640, 360) + b"\0" * 20)
    (root / "sub" / "c.bmp").write_bytes(b"BM" + b"\0" * 12 + struct.pack("<IiiHH", 40, 7, -9, 1, 24) + b"\0" * 24)
    (root / "sub" / "d.psd").write_bytes(b"8BPS\0\1" + b"\0" * 6 + struct.pack(">HIIHH", 4, 50, 60, 8, 3))
    (root / "e.ico").write_bytes(b"\0\0\1\0\1\0" + bytes([0, 32, 0, 0]))
    (root / "bad.png").write_bytes(b"not an image")
    (root / "note.txt").write_bytes(b"text")
    return root


def test_scan_lists_supported_files(spark, corpus):
    deep = scan.scan_inputs(spark, [str(corpus)])
    assert sorted(r.path.rsplit("/", 1)[1] for r in deep.collect()) == ["a.png", "b.GIF", "bad.png", "c.bmp", "d.psd", "e.ico"]
    flat = scan.scan_inputs(spark, [str(corpus)], recursive=False)
    assert sorted(r.path.rsplit("/", 1)[1] for r in flat.collect()) == ["a.png", "b.GIF", "bad.png", "e.ico"]


def test_headers(spark, corpus):
    files = scan.read_content(spark, [str(corpus)], "*.*").withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    good, bad = headers.probe_headers(files.select("name", "content"))
    rows = {r.name: (r.kind, r.width, r.height, r.channels, r.bit_depth, r.color_mode, r.has_alpha_channel) for r in good.collect()}
    assert rows == {
        "a.png": ("png", 2, 1, 4, 8, "RGBA", True),
        "b.GIF": ("gif", 640, 360, None, 8, "Indexed", None),
        "c.bmp": ("bmp", 7, 9, None, 24, None, None),
        "d.psd": ("psd", 60, 50, 4, 8, "RGB", True),
        "e.ico": ("ico", 256, 32, None, None, None, None),
    }
    assert sorted(r.name for r in bad.collect()) == ["bad.png", "note.txt"]


def test_pixels(spark, corpus):
    images, failures = rasters.read_pixels(spark, str(corpus / "*.png"))
    px = rasters.pixel_arrays(images).first().px
    assert [tuple(p) for p in px] == [(10, 20, 30, 255), (40, 50, 60, 0)]
    assert [r.file_name for r in failures.collect()] == ["bad.png"]


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    assert history.load(spark, path).count() == 0
    runs = spark.range(20).select(
        F.col("id").alias("run_id"),
        F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")).alias("run_ts"),
        F.lit("manual").alias("trigger_source"), F.lit("png").alias("output_format"), F.lit(5).cast("bigint").alias("original_bytes"),
        F.lit(False).alias("was_canceled"),
    )
    history.append(runs.filter("id < 15"), path)
    history.append(runs.filter("id >= 15"), path)
    (tmp_path / "history" / "run_month=2024-02" / "broken.json").write_text("{not json\n")
    assert [r.run_id for r in history.load(spark, path).collect()] == list(range(19, 7, -1))
    history.clear(spark, path)
    assert history.load(spark, path).count() == 0


def history_rows(spark, ids, days=20):
    at = F.timestamp_add("DAY", (F.col("id") * days).cast("int"), F.lit("2023-01-05 00:00:00").cast("timestamp_ntz"))
    return spark.range(ids.start, ids.stop).select(
        F.col("id").alias("run_id"), at.alias("run_ts"), F.lit("manual").alias("trigger_source"), F.lit("png").alias("output_format"),
        F.lit(5).cast("bigint").alias("original_bytes"), F.lit(False).alias("was_canceled"),
    )


def months_read(rows):
    return {f.split("run_month=")[1].split("/")[0] for f in rows.inputFiles()}


def test_history_reads_the_newest_months(spark, tmp_path):
    path = str(tmp_path / "history")
    history.append(history_rows(spark, range(0, 40)), path)
    history.append(history_rows(spark, range(40, 60)), path)
    months = {r.run_month: r.rows for r in history.manifest(spark, path).collect()}
    assert sum(months.values()) == 60 and len(months) == 39  # from January 2023 on
    newest = history.load(spark, path)
    assert [r.run_id for r in newest.collect()] == list(range(59, 47, -1))
    last = sorted(months)[::-1]
    few = next(k for k in range(1, 40) if sum(months[m] for m in last[:k]) >= 12)
    assert months_read(newest) == set(last[:few])
    assert [r.run_id for r in history.load(spark, path, 500).collect()] == list(range(59, -1, -1))

    # lines of the newest month are lost, and an append stopped after its count: older months make up for both
    for f in (tmp_path / "history" / f"run_month={last[0]}").glob("*.json"):
        f.write_text("{not json\n" * months[last[0]])
    for f in (tmp_path / "history" / f"run_month={last[0]}").glob(".*.crc"):
        f.unlink()
    history._counted(history._monthly(history_rows(spark, range(90, 110)))).write.mode("append").json(history._manifest_path(path))
    left = [i for i in range(59, -1, -1) if i < 60 - months[last[0]]]
    assert [r.run_id for r in history.load(spark, path).collect()] == left[:12]


def test_history_from_before_the_manifest(spark, tmp_path):
    path = str(tmp_path / "history")
    history._monthly(history_rows(spark, range(0, 20))).write.partitionBy("run_month").json(path)
    assert [r.run_id for r in history.load(spark, path, 3).collect()] == [19, 18, 17]
    history.append(history_rows(spark, range(20, 22)), path)
    assert sum(r.rows for r in history.manifest(spark, path).collect()) == 22
    assert [r.run_id for r in history.load(spark, path, 4).collect()] == [21, 20, 19, 18]
    # no rows, and rows without a time, which no reader returns
    history.append(history_rows(spark, range(22, 23)).withColumn("run_ts", F.lit(None).cast("timestamp_ntz")), path)
    history.append(history_rows(spark, range(0, 0)), path)
    assert [r.run_id for r in history.load(spark, path, 2).collect()] == [21, 20]


def test_presets(spark):
    stored = spark.createDataFrame(
        [(1, '{"name":"Web","quality":40,"model_code":"old"}'), (2, '{"name":"print"}'), (3, '{"name":" WEB ","quality":70}'), (4, '{"name":" "}')],
        "saved_at long, body string",
    )
    rows = {r.name: r for r in presets.upsert(presets.load_presets(stored, ["old"])).collect()}
    assert set(rows) == {"WEB", "print"}
    assert (rows["WEB"].position, rows["WEB"].quality, rows["WEB"].model_code) == (1, 70, "standard")
    assert all(rows["print"][k] == v for k, v in PRESET_DEFAULTS.items() if k != "name")
    back = presets.dump_presets(presets.upsert(presets.load_presets(stored, ["old"])))
    again = presets.load_presets(back.withColumnRenamed("position", "saved_at"), [])
    assert sorted(r.name for r in again.collect()) == ["WEB", "print"]


def test_failure_log(spark, tmp_path, small_groups):
    summary = spark.createDataFrame([
        Row(run_id=1, trigger_source="manual", output_format="png", total_count=5, processed_count=5, success_count=3, failure_count=2, was_canceled=False),
        Row(run_id=2, trigger_source="watch", output_format="png", total_count=1, processed_count=1, success_count=1, failure_count=0, was_canceled=False),
    ])
    inputs = spark.createDataFrame([(1, i, f"/in/{i}.png") for i in range(5)] + [(2, 0, "/in/z.png")], "run_id long, i int, path string")
    failures = spark.createDataFrame([(1, "b.png", "broken"), (1, "A.png", "locked")], "run_id long, file_name string, reason string")
    lines = failure_log.failure_log(summary, inputs, failures, ["i"], ["reason"])
    got = [r.line for r in lines.orderBy("run_id", "line_no").collect()]
    assert got[:2] == ["Run report", "started by: manual"]
    assert got[9:] == ["Inputs:", *[f"- /in/{i}.png" for i in range(5)], "", "Not converted:", "- A.png: locked", "- b.png: broken"]
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == list(range(1, len(got) + 1))
    failure_log.write_log(lines, str(tmp_path / "log"))
    stored = [r.value for r in spark.read.text(str(tmp_path / "log" / "run_id=1")).collect()]
    assert sorted(stored) == sorted(got)


def test_plan_sink_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "plan")
    rows = spark.createDataFrame([(1, "png", 1, 1), (1, "png", 2, 1), (2, "gif", 3, 1)], "job_id long, output_format string, asset_id long, output_no long")
    plan_sink.write_plan(rows, path)
    plan_sink.write_plan(rows.filter("asset_id = 1"), path)
    assert sorted(r.asset_id for r in spark.read.parquet(path).collect()) == [1, 3]
    plan_sink.write_plan(rows.filter("job_id = 2"), path, overwrite=False)
    assert spark.read.parquet(path).count() == 3


ASSETS = [
    (1, 1, "/in/a.png", "a.png", ".png", 100, 50, 50, 1, 0, False, False, True, False),
    (2, 1, "/in/a.jpg", "a.jpg", ".jpg", 100, 5, 5, 1, 0, False, False, True, False),
    (3, 1, "/in/b.pdf", "b.pdf", ".pdf", 100, 0, 0, 1, 3, True, True, False, False),
    (4, 1, "/in/a.webp", "a.webp", ".webp", 100, 50, 50, 1, 0, False, False, True, False),
    (5, 1, "/in/g.gif", "g.gif", ".gif", 100, 50, 50, 4, 0, False, False, True, False),
    (6, 2, "/in/x.png", "x.png", ".png", 100, 50, 50, 1, 0, False, False, True, False),
]
ASSET_COLUMNS = (
    "asset_id long, job_id long, path string, file_name string, ext string, size_bytes long, width long, height long, frame_count long, "
    "page_count long, is_pdf boolean, is_encrypted boolean, is_unlocked boolean, has_alpha boolean"
)


def job(job_id, **changes):
    base = dict(
        job_id=job_id, output_format="png", compression_mode="custom", quality=90, resize_mode="none", resize_width=1, resize_height=1,
        resize_percent=100, rename_mode="keep", rename_prefix="", rename_suffix="", rename_start=1, rename_digits=2, folder_rule="specific",
        output_directory="/out", auto_folder="", allow_overwrite=False, svg_use_background=False, svg_background_color="",
        icon_use_transparency=True, icon_background_color="", language_code="", gif_mode="all", gif_frame_index=0,
        pdf_image_mode="all_pages", pdf_doc_mode="all_pages", pdf_page_index=0, model_stage=True, model_scale=2,
    )
    return Row(**(base | changes))


def flaky(rows, model, device):
    if model == "standard":
        raise conversion.ModelLoadError("no such model")
    if device == "gpu":
        raise RuntimeError("no gpu")
    if (rows["width"] < 10).any():
        raise ValueError("too small")
    return [f"/m/{name}" for name in rows["file_name"]]


def test_model_stage_falls_back(spark):
    assets = spark.createDataFrame(ASSETS, ASSET_COLUMNS).coalesce(1)
    stage = conversion.model_stage(assets, flaky)
    done = {r.path: (r.output_path, r.model_used, r.device_used) for r in stage.results.collect()}
    assert done == {p: (f"/m/{p[4:]}", "general", "cpu") for p in ("/in/a.png", "/in/a.webp", "/in/x.png")}
    assert [(r.path, r.reason) for r in stage.failures.collect()] == [("/in/a.jpg", "too small")]
    assert {r.job_id: r.eligible_inputs for r in stage.eligible.collect()} == {1: 3, 2: 1}


def test_model_stage_runs_the_jobs_own_model(spark):
    assets = spark.createDataFrame(ASSETS, ASSET_COLUMNS).coalesce(1)
    jobs = spark.createDataFrame([(1, True, "fine"), (2, False, "fine")], "job_id long, model_stage boolean, resolved_model string")
    calls = lambda rows, model, device: [f"{model}:{len(rows)}:{name}" for name in rows["file_name"]]
    stage = conversion.model_stage(assets, calls, jobs)
    assert {r.job_id for r in stage.results.collect()} == {1}
    assert all(r.output_path.startswith("fine:3:") and r.device_used == "gpu" for r in stage.results.collect())


def test_run_numbers_the_remainder(spark):
    assets = spark.createDataFrame(ASSETS, ASSET_COLUMNS)
    jobs = spark.createDataFrame([job(1, rename_mode="number"), job(2)])
    stage = conversion.model_stage(assets, flaky)
    run = conversion.run_conversion(assets, jobs, ["asset_id"], stage=stage)
    paths = {(r.asset_id, r.output_no): r.output_path for r in run["outputs"].collect()}
    # the small image left before numbering; the locked document kept number 02
    assert paths == {
        (1, 1): "/out/01.png", (4, 1): "/out/03.png", (6, 1): "/out/x.png",
        **{(5, n): f"/out/04/frame_{n}.png" for n in range(1, 5)},
    }
    rows = {r.job_id: (r.total_count, r.processed_count, r.success_count, r.failure_count) for r in run["summary"].collect()}
    assert rows == {1: (5, 5, 3, 2), 2: (1, 1, 1, 0)}
    assert sorted((r.file_name, r.reason) for r in run["failures"].collect()) == [("a.jpg", "too small"), ("b.pdf", "locked")]


def test_run_with_nothing_left(spark):
    assets = spark.createDataFrame(ASSETS[1:2], ASSET_COLUMNS)
    stage = conversion.model_stage(assets, flaky)
    run = conversion.run_conversion(assets, spark.createDataFrame([job(1)]), ["asset_id"], stage=stage)
    assert run["outputs"].count() == 0
    assert tuple(run["summary"].first()) == (1, 1, 1, 1, 0)


def committed(store):
    paths = lambda run: sorted(r.output_path for r in store.read("outputs", run).collect())
    return {r.run_id: paths(r.run_id) for r in store.commits().collect()}


def test_runs_are_committed_as_a_whole(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "runs"))
    assert store.commits().count() == store.read("outputs").count() == store.recent().count() == 0
    assets, jobs = spark.createDataFrame(ASSETS, ASSET_COLUMNS), spark.createDataFrame([job(1), job(2), job(3)])
    at = datetime(2024, 5, 6, tzinfo=timezone.utc)
    runs.commit_run(store, "007", assets.filter("job_id = 2"), jobs, ["asset_id"], started=at, finished=at + timedelta(seconds=2))
    assert committed(store) == {"007": ["/out/x.png"]}
    # a run stopped after some of its tables is not seen, also where it repeats a committed one
    broken = store.begin("007")
    broken.write("outputs", store.read("outputs"))
    store.begin("008").write("outputs", store.read("outputs"))
    assert committed(store) == {"007": ["/out/x.png"]}
    assert {r.run_id for r in store.leftovers().collect()} == {"007", "008"}
    # a second run takes the first one's names into account; a repeat replaces
    runs.commit_run(store, "009", assets.filter("job_id = 2"), jobs, ["asset_id"], reserved=store.names("009"), started=at, finished=at)
    assert committed(store) == {"007": ["/out/x.png"], "009": ["/out/x(1).png"]}
    runs.commit_run(store, "007", assets, jobs, ["asset_id"], reserved=store.names("007"), started=at, finished=at)
    assert committed(store)["007"] == ["/out/a(1).png", "/out/a(2).png", "/out/a.png", *[f"/out/g/frame_{n}.png" for n in range(1, 5)], "/out/x.png"]
    assert {r.number for r in store.commits().filter("run_id = '007'").collect()} == {2}
    told = {r.job_id: (r.total_count, r.success_count, r.failure_count, r.original_bytes) for r in store.read("history", "007").collect()}
    assert told == {1: (5, 4, 1, 500), 2: (1, 1, 0, 100), 3: (0, 0, 0, 0)}
    assert [(r.job_id, r.reason) for r in store.read("failures", "007").collect()] == [(1, "locked")]
    lines = [r.line for r in store.read("log", "007").orderBy("line_no").collect()]
    assert lines[0] == "Run report" and lines[-1] == "- b.pdf: locked" and "- /in/g.gif" in lines
    assert len(store.recent(4).collect()) == 4
    with pytest.raises(ValueError, match="named by"):
        store.begin("a/b")


def test_a_reader_of_runs_skips_other_attempts(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "runs"))
    row = spark.range(1).select(F.lit(1).alias("job_id"), F.lit("/out").alias("folder"))
    for n in range(3):
        attempt = store.begin("r")
        attempt.write("directories", row)
        attempt.commit()
    store.begin("q").write("directories", row)
    found = store.read("directories")
    assert [(r.run_id, r.folder) for r in found.collect()] == [("r", "/out")]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_long_files_keep_their_row(spark, corpus):
    files = {r.path.rsplit("/", 1)[1]: r for r in scan.read_content(spark, [str(corpus)], "*.*", max_bytes=30).collect()}
    assert len(files) == scan.read_content(spark, [str(corpus)], "*.*").count()
    for name, r in files.items():
        assert r.truncated == (r.length > 30) == (r.content is None), name


def test_documents_are_read_whole_unless_told(spark):
    body = b"%PDF-1.7 " + b"x" * 600 + b"/Encrypt << " + b"y" * 600 + b" /P -44 >> tail"
    docs = spark.createDataFrame([(bytearray(body),), (None,)], "content binary")
    text, cut = display.document_sample(F.col("content"))
    part, part_cut = display.document_sample(F.col("content"), 100)
    row, empty = docs.select(
        text.alias("t"), cut.alias("c"), part.alias("p"), part_cut.alias("pc"),
        display.permission_flags(text).alias("f"), display.permission_flags(text, 512).alias("near"),
    ).collect()
    assert (row.t.encode("latin-1"), row.c, row.f, row.near) == (body, False, -44, None)
    assert (row.p, row.pc) == ((body[:100] + b"\n" + body[-100:]).decode("latin-1"), True)
    assert (empty.t, empty.c, empty.p, empty.pc) == (None, None, None, None)


def test_failure_log_deals_runs_out_by_rows(spark):
    summary = spark.createDataFrame([(r, "manual", "png", 3, 3, 2, 1, False) for r in range(40)], "run_id long, trigger_source string, output_format string, total_count long, processed_count long, success_count long, failure_count long, was_canceled boolean")
    inputs = spark.createDataFrame([(r, i, f"/in/{i}.png") for r in range(40) for i in range(3)], "run_id long, i int, path string")
    failures = spark.createDataFrame([(r, "0.png", "bad") for r in range(40)], "run_id long, file_name string, reason string")
    log = lambda **o: failure_log.failure_log(summary, inputs, failures, ["i"], ["reason"], **o)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = log(), log(task_rows=2)
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
        assert "hashpartitioning(run_id" in (plan := many._jdf.queryExecution().toString()) and ", 60), REPARTITION_BY_NUM" in plan  # 120 inputs
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
