"""Rules against the values the product's own tests expect, and edge rows."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

from assetflow.functions import content, display, geometry, naming, options, raster, text
from assetflow.operators import detections, lookups, pixels, sets, tiles
from assetflow.plans import details, planning
from assetflow.plans.outcomes import summarize_batch
from assetflow.schemas import invalid_options

JOB = {
    "job_id": 1, "output_format": "png", "compression_mode": "custom", "quality": 90, "resize_mode": "none", "resize_width": 0,
    "resize_height": 0, "resize_percent": 100, "rename_mode": "keep", "gif_mode": "first", "pdf_image_mode": "current_page",
    "pdf_doc_mode": "all_pages", "folder_rule": "source", "model_stage": False, "gif_frame_index": 0, "pdf_page_index": 0,
}
ASSET = {
    "asset_id": 1, "path": "/in/a.png", "file_name": "a.png", "ext": ".png", "size_bytes": 1024, "width": 800, "height": 600,
    "frame_count": 1, "page_count": 0, "is_pdf": False, "is_encrypted": False, "is_unlocked": True, "has_alpha": False,
}


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("v")).first().v


def plan(spark, *rows):
    return spark.createDataFrame([Row(**(ASSET | JOB | r)) for r in rows])


def test_format_table(spark):
    df = spark.createDataFrame([(f,) for f in ["png", "jpeg", "webp", "bmp", "gif", "tiff", "ico", "svg", "pdf"]], "output_format string")
    rows = {r[0]: (r[1], r[2]) for r in df.select("output_format", options.output_extension(), options.supports_alpha()).collect()}
    assert rows == {
        "png": (".png", True), "jpeg": (".jpg", False), "webp": (".webp", True), "bmp": (".bmp", True), "gif": (".gif", False),
        "tiff": (".tiff", True), "ico": (".ico", True), "svg": (".svg", True), "pdf": (".pdf", False),
    }


def test_compression_risk_and_disclaimer(spark):
    df = plan(spark, {"output_format": "webp", "compression_mode": "high_compression", "model_stage": True})
    row = planning.plan_diagnostics(df).first()
    assert (row.high_compression_risk, row.scale_disclaimer, row.expansion_disclaimer, row.locked_inputs) == (True, True, False, 0)


def test_large_animation_and_locked_document(spark):
    df = plan(
        spark,
        {"ext": ".gif", "path": "/in/a.gif", "frame_count": 720, "output_format": "pdf", "gif_mode": "all"},
        {"asset_id": 2, "ext": ".pdf", "is_pdf": True, "page_count": 3, "is_encrypted": True, "is_unlocked": False, "output_format": "pdf", "gif_mode": "all"},
    )
    row = planning.plan_diagnostics(df).first()
    assert (row.large_frame_count, row.locked_inputs, row.scale_disclaimer, row.expansion_disclaimer) == (720, 1, False, True)


def test_watch_rules(spark):
    def modes(fmt):
        df = plan(
            spark,
            {"asset_id": 1, "frame_count": 5, "output_format": fmt},
            {"asset_id": 2, "is_pdf": True, "page_count": 4, "output_format": fmt},
        )
        rows = options.watch_rules(df).orderBy("asset_id").collect()
        return rows[0].gif_mode, rows[1].pdf_image_mode

    assert modes("png") == ("all", "all_pages")
    assert modes("gif") == ("first", "all_pages")
    assert modes("pdf") == ("all", "current_page")


def test_frame_progress_only_for_gif_to_pdf(spark):
    df = spark.createDataFrame([("pdf", "animated.gif", 12, 48), ("pdf", "a.png", 12, 48), ("png", "a.gif", 1, 48), ("pdf", "A.GIF", 0, 48)], "f string, n string, d long, t long")
    index, count = display.sub_item(F.col("f"), F.col("n"), F.col("d"), F.col("t"))
    assert [tuple(r) for r in df.select(index, count).collect()] == [(12, 48), (None, None), (None, None), (1, 48)]


def test_history_lines(spark):
    run = spark.createDataFrame(
        [Row(trigger_source="manual", output_format="webp", total_count=9, processed_count=7, success_count=5, failure_count=2,
             was_canceled=True, original_bytes=2048, estimated_min=1024, estimated_max=1536, duration_ms=18000)]
    )
    row = run.select(display.history_summary_line().alias("s"), display.history_detail_line().alias("d")).first()
    assert row.s == "Manual · WEBP · Processed 7/9 before cancellation"
    assert row.d == "Input 2.0 KB · Estimate 1.0 KB - 1.5 KB · Duration 00:18.00"


def test_locked_input_summary(spark):
    work = spark.createDataFrame([(1, False, "a"), (1, True, "b")], "run_id long, failed boolean, file_name string")
    runs = spark.createDataFrame([(1, False)], "run_id long, was_canceled boolean")
    row = summarize_batch(work, runs).first()
    assert (row.total_count, row.processed_count, row.success_count, row.failure_count) == (2, 2, 1, 1)


def test_durations_and_sizes(spark):
    df = spark.createDataFrame([(0,), (59990,), (3600000,), (36061000,)], "ms long")
    assert [r[0] for r in df.select(display.format_duration("ms")).collect()] == ["00:00.00", "00:59.99", "1:00:00", "10:01:01"]
    df = spark.createDataFrame([(-5,), (1023,), (1280,), (1048576,)], "n long")
    assert [r[0] for r in df.select(display.format_bytes("n")).collect()] == ["0 B", "1023 B", "1.3 KB", "1.0 MB"]


def test_rational_and_page_sizes(spark):
    df = spark.createDataFrame([(1, 0), (28, 10), (1, 250)], "n long, d long")
    v = display.rational(F.col("n"), F.col("d"))
    rows = [tuple(r) for r in df.select(display.aperture_text(v), display.shutter_text(v)).collect()]
    assert rows == [(None, None), ("f/2.8", "2.8 s"), ("f/0.0", "1/250 s")]
    df = spark.createDataFrame([(595.0, 842.0), (842.0, 595.0), (612.0, 792.0), (100.0, 100.0)], "w double, h double")
    assert [r[0] for r in df.select(geometry.page_size_class("w", "h")).collect()] == ["A4", "A4", "Letter", None]
    assert df.select(display.page_size_text("w", "h")).first()[0] == "A4 (209.9 x 297 mm)"


def test_empty_image_dimensions(spark):
    df = plan(spark, {"width": 0, "resize_mode": "fixed_height", "resize_height": 10}, {"width": 3, "height": 2, "resize_mode": "scale_percent", "resize_percent": 50})
    w, h = geometry.target_dimensions()
    assert [tuple(r) for r in df.select(w, h).collect()] == [(1, 1), (2, 1)]


def test_numbered_names_are_never_cut(spark):
    df = spark.createDataFrame([(12345, 4), (7, 4)], "n long, d long")
    assert [r[0] for r in df.select(naming.zero_padded(F.col("n"), F.col("d"))).collect()] == ["12345", "0007"]


def test_overlapping_paths(spark):
    df = spark.createDataFrame([("/w/A", "/w/a/out"), ("/w/a", "/w/ab"), ("/w/a/", "/W/A")], "a string, b string")
    assert [r[0] for r in df.select(naming.paths_overlap("a", "b")).collect()] == [True, False, True]


def test_text_cleanup(spark):
    df = spark.createDataFrame([("\r\n a  \r\n\r\n \t\r\nb\r c \n\n",), ("  \n \n",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalize_text("t")).collect()] == ["a\n\nb\n c", "", ""]


def test_urls(spark):
    df = spark.createDataFrame([(1, "x HTTP://Ex.org/A). http://ex.org/a, https://b.c?q=1! http:// y")], "id int, text string")
    rows = text.extract_urls(df, "id").orderBy("position").collect()
    assert [(r.position, r.url) for r in rows] == [(0, "http://ex.org/A"), (2, "https://b.c/?q=1")]


def test_scores_need_text(spark):
    df = spark.createDataFrame([("  \n", 0.9), ("abc", 0.5)], "text string, confidence double")
    df = text.with_script_stats(df)
    rows = df.select(*[c.alias(n) for n, c in text.script_scores().items()]).collect()
    assert rows[0].english == float("-inf")
    assert abs(rows[1].english - (50 + 0.35 * 3 + 18 + 0.9 - 6)) < 1e-9


def test_map_characters_for_selected_language(spark):
    texts = spark.createDataFrame([("漢國", "zh"), ("漢國", "ja")], "text string, lang string")
    table = spark.createDataFrame([("漢", "汉"), ("國", "国")], "source string, target string")
    assert [r.text for r in text.map_characters_for(texts, table, "lang", "zh").collect()] == ["汉国", "漢國"]


def test_confidence_skips_bad_scores(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, [0.5, nan, inf], 0.1), (1, [], 0.9), (2, [], nan), (3, [3.0], 0.0)], "image_id int, scores array<double>, box_score double")
    rows = {r.image_id: r.confidence for r in detections.mean_confidence(df).collect()}
    assert rows == {1: 0.7, 2: 0.0, 3: 1.0}


def test_equal_tensor_and_empty_mask(spark):
    df = spark.createDataFrame([([5.0, 5.0], [0, 0])], "v array<double>, m array<bigint>")
    row = df.select(raster.minmax_normalize("v").alias("n"), *[c.alias(k) for k, c in raster.mask_metrics("m").items()]).first()
    assert (row.n, row.mean_alpha_pct, row.foreground_pct) == ([1.0, 1.0], 0.0, 0.0)


def test_posterize_keeps_clear_pixels(spark):
    df = spark.createDataFrame([([Row(r=100, g=200, b=30, a=0), Row(r=100, g=200, b=30, a=9)],)], "px array<struct<r:bigint,g:bigint,b:bigint,a:bigint>>")
    out = df.select(raster.posterize("px", F.lit(10)).alias("p"), raster.posterize("px", F.lit(100)).alias("q")).first()
    assert tuple(out.p[0]) == (100, 200, 30, 0) and tuple(out.p[1]) == (0, 255, 0, 9)
    assert tuple(out.q[1]) == (100, 200, 30, 9)


def test_overlapping_rectangles_keep_the_smaller_in_the_earlier_slot(spark):
    rects = spark.createDataFrame(
        [(1, 0, 0, 0, 100, 100), (1, 1, 300, 0, 10, 10), (1, 2, 5, 5, 80, 80), (1, 3, 0, 0, 90, 90), (1, 4, 0, 0, 0, 9)],
        "asset_id int, ord long, x long, y long, w long, h long",
    )
    rows = tiles.suppress_overlaps(rects).orderBy("slot").collect()
    assert [(r.x, r.w) for r in rows] == [(5, 80), (300, 10)]


def test_bands_split_and_short_runs_drop(spark):
    dark, light = Row(r=0, g=0, b=0, a=255), Row(r=255, g=255, b=255, a=255)
    rows = [[dark if x < 14 or 20 <= x < 25 else light for x in range(40)] for _ in range(30)]
    df = spark.createDataFrame([(1, 40, 30, sum(rows, []))], "image_id int, width long, height long, px array<struct<r:bigint,g:bigint,b:bigint,a:bigint>>")
    got = pixels.axis_bands(df).select("axis", "start", "end").collect()
    assert sorted(map(tuple, got)) == [("column", 0, 14), ("row", 0, 30)]


def test_dilation_reaches_a_square(spark):
    mask = [0] * 25
    mask[12] = 255
    df = spark.createDataFrame([(1, 5, 5, mask)], "image_id int, width long, height long, mask array<bigint>")
    out = pixels.dilate_mask(df, 1).first().mask
    assert [i for i, v in enumerate(out) if v] == [6, 7, 8, 11, 12, 13, 16, 17, 18]


def test_paths_merge(spark):
    first = spark.createDataFrame([(0, " /a/X.png "), (1, "  ")], "ord int, path string")
    second = spark.createDataFrame([(0, "/A/x.PNG"), (1, "/b.png")], "ord int, path string")
    assert sorted(r.path for r in sets.merge_path_requests(first, second).collect()) == ["/a/X.png", "/b.png"]


def test_translate_falls_back(spark):
    strings = spark.createDataFrame([("en", "k", "hello"), ("de", "k", "hallo"), ("en", "only", "base")], "locale string, key string, value string")
    keys = spark.createDataFrame([("k",), ("only",), ("none",)], "key string")
    rows = {r.key: r.text for r in lookups.translate(keys, strings, "de", "en").collect()}
    assert rows == {"k": "hallo", "only": "base", "none": "none"}


def test_model_resolution(spark):
    jobs = spark.createDataFrame([(1, "old"), (2, "anime"), (3, "light"), (4, "typo")], "job_id int, model_code string")
    models = spark.createDataFrame(
        [("old", True, False), ("standard", False, True), ("anime", False, False), ("light", False, True), ("general", False, True)],
        "model_code string, retired boolean, available boolean",
    )
    rows = {r.job_id: (r.resolved_model, r.used_fallback) for r in lookups.resolve_model(jobs, models).collect()}
    assert rows == {1: ("standard", False), 2: ("general", True), 3: ("light", False), 4: ("general", True)}
    none = lookups.resolve_model(jobs, models.filter("model_code = 'anime'")).collect()
    assert {r.model_error for r in none} == {"no model available"}


def test_invalid_codes_are_found(spark):
    df = plan(spark, {}, {"output_format": "heic"}, {"gif_mode": None})
    assert invalid_options(df).count() == 2


def test_content_rules(spark):
    df = plan(
        spark,
        {"file_name": "my_Logo.png"},
        {"width": 100, "height": 110, "has_alpha": True},
        {"width": 100, "height": 200, "has_alpha": True},
        {"ext": ".SVG"},
        {"width": 1000, "height": 600},
        {"width": 799, "height": 900},
    )
    assert [r[0] for r in df.select(content.content_kind()).collect()] == ["icon", "icon", "transparent_graphic", "vector", "photo", "unknown"]


def test_detail_sheets_take_optional_columns(spark):
    df = plan(spark, {"ext": ".psd", "file_name": "a.psd"}, {"asset_id": 2}).withColumns(
        {"layers": F.lit(3), "has_text": F.lit(True), "author": F.lit("Ann")}
    )
    rows = {(r.asset_id, r.label): r.value for r in details.detail_rows(df).collect()}
    assert rows[1, "Layer count"] == "3" and rows[1, "Text layers"] == "Yes" and rows[1, "Author"] is None
    assert rows[2, "Layer count"] is None and rows[2, "Size"] == "1.0 KB (1,024 B)"
    text_of = {r.asset_id: r.text for r in details.detail_text(details.detail_rows(df)).collect()}
    assert text_of[1].startswith("[General]\nName: a.psd\n") and "[Layers]\nLayer count: 3" in text_of[1]
