"""Aggregations (D), sorts and top-k (F), warnings (G4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetflow.fixtures import assets_jobs, derive, duck, recognitions
from assetflow.operators import detections as DT
from assetflow.operators import frames, layers
from assetflow.plans import estimate, outcomes, planning
from assetflow.queries.base import query, rounded
from assetflow.queries.rules import DIMS_SQL

ESTIMATE_SQL = f"""
, d AS (SELECT *, greatest(1.0::DOUBLE, CAST(size_bytes AS DOUBLE)) AS ob, greatest(1.0::DOUBLE, CAST(width * height AS DOUBLE)) AS sp,
    CASE compression_mode WHEN 'high_quality' THEN 92 WHEN 'balanced' THEN 80 WHEN 'high_compression' THEN 60 ELSE least(greatest(quality, 1), 100) END / 100.0::DOUBLE AS q FROM (SELECT *, {DIMS_SQL} FROM aj)),
t AS (SELECT *, greatest(1.0::DOUBLE, CAST(target_width AS DOUBLE) * greatest(1, target_height)) AS tp FROM d),
s AS (SELECT *, ob * (tp / sp) AS sc, CASE WHEN output_format IN ('png','bmp','svg') THEN 0.28::DOUBLE WHEN output_format = 'ico' THEN 0.25::DOUBLE ELSE 0.18::DOUBLE END AS v FROM t),
b AS (SELECT *, CASE output_format WHEN 'png' THEN sc * CASE WHEN has_alpha THEN 0.9::DOUBLE ELSE 1.35::DOUBLE END WHEN 'jpeg' THEN sc * (0.36::DOUBLE + q * 0.72::DOUBLE) WHEN 'webp' THEN sc * (0.26::DOUBLE + q * 0.58::DOUBLE)
    WHEN 'gif' THEN sc * 0.82::DOUBLE WHEN 'tiff' THEN sc * 1.1::DOUBLE WHEN 'svg' THEN sc * 1.2::DOUBLE WHEN 'bmp' THEN tp * 4 + 64 WHEN 'ico' THEN least(greatest(tp / 5, 4096), 262144) ELSE ob END AS base FROM s),
m AS (SELECT *, greatest(512.0::DOUBLE, base * (1 - v)) AS min_bytes, greatest(greatest(512.0::DOUBLE, base * (1 - v)), base * (1 + v)) AS max_bytes FROM b)
"""


@query(duck("assets jobs aj", ESTIMATE_SQL + """
SELECT job_id, count(*) AS inputs, CAST(sum(size_bytes) AS BIGINT) AS original_bytes, CAST(round_even(CAST(sum(CAST(round(min_bytes, 6) AS DECIMAL(28, 6))) AS DOUBLE), 0) AS BIGINT) AS estimated_min,
  CAST(round_even(CAST(sum(CAST(round(max_bytes, 6) AS DECIMAL(28, 6))) AS DOUBLE), 0) AS BIGINT) AS estimated_max FROM m GROUP BY job_id"""))
def estimate_sizes(spark, sf):
    return estimate.estimate_sizes(assets_jobs(spark, sf))


@query(duck("assets jobs aj", ESTIMATE_SQL + "SELECT asset_id, job_id, round(min_bytes, 4) AS min_bytes, round(max_bytes, 4) AS max_bytes FROM m"))
def estimate_rows(spark, sf):
    return estimate.with_estimates(assets_jobs(spark, sf)).select(
        "asset_id", "job_id", F.round("min_bytes", 4).alias("min_bytes"), F.round("max_bytes", 4).alias("max_bytes")
    )


PLAN_SQL = """
, w AS (SELECT *, CASE WHEN is_pdf THEN CASE WHEN greatest(page_count, 1) > 1 AND ((output_format = 'pdf' AND pdf_doc_mode = 'split') OR (output_format <> 'pdf' AND pdf_image_mode = 'all_pages')) THEN page_count ELSE 1 END
    WHEN frame_count > 1 AND gif_mode = 'all' AND output_format <> 'gif' THEN frame_count ELSE 1 END AS items FROM aj),
p AS (SELECT job_id, count(*) AS inputs, bool_or(model_stage) AS model_enabled, count_if(model_stage AND NOT is_pdf AND frame_count <= 1 AND lower(ext) IN ('.jpg','.jpeg','.png','.webp','.bmp','.tif','.tiff','.gif')) AS eligible_inputs,
    count_if(frame_count > 1 AND gif_mode = 'all' AND output_format <> 'gif') AS gif_expansion_inputs, count_if(is_pdf AND items > 1) AS pdf_expansion_inputs,
    count_if(output_format IN ('jpeg','gif','pdf') AND NOT is_pdf AND has_alpha) AS forced_background_inputs,
    bool_or(output_format IN ('jpeg','webp') AND (compression_mode = 'high_compression' OR (compression_mode = 'custom' AND quality <= 45))) AS high_compression_risk,
    CAST(max(CASE WHEN output_format = 'pdf' AND gif_mode = 'all' AND frame_count > 500 THEN frame_count ELSE 0 END) AS BIGINT) AS large_frame_count,
    count_if(is_encrypted AND NOT is_unlocked) AS locked_inputs, CAST(sum(items) AS BIGINT) AS work_items FROM w GROUP BY job_id)
"""
# the same for every job, also one without inputs
EVERY_SQL = PLAN_SQL.replace("p AS (", "p0 AS (") + """
, p AS (SELECT j.job_id, coalesce(inputs, 0) AS inputs, coalesce(p0.model_enabled, j.model_stage) AS model_enabled, coalesce(eligible_inputs, 0) AS eligible_inputs, coalesce(gif_expansion_inputs, 0) AS gif_expansion_inputs,
    coalesce(pdf_expansion_inputs, 0) AS pdf_expansion_inputs, coalesce(forced_background_inputs, 0) AS forced_background_inputs, coalesce(high_compression_risk, FALSE) AS high_compression_risk,
    coalesce(large_frame_count, 0) AS large_frame_count, coalesce(locked_inputs, 0) AS locked_inputs, coalesce(work_items, 0) AS work_items FROM jobs j LEFT JOIN p0 ON j.job_id = p0.job_id)
"""


@query(duck("assets jobs aj", EVERY_SQL + """
SELECT job_id, inputs, model_enabled, eligible_inputs, gif_expansion_inputs, gif_expansion_inputs > 0 AS expands_gif_frames, pdf_expansion_inputs, pdf_expansion_inputs > 0 AS expands_pdf_pages, forced_background_inputs FROM p"""))
def plan_rules(spark, sf):
    return planning.plan_rules(assets_jobs(spark, sf), derive(spark, sf, "jobs"))


@query(duck("assets jobs aj", EVERY_SQL + """
SELECT job_id, high_compression_risk, large_frame_count, locked_inputs, model_enabled AND eligible_inputs > 0 AS scale_disclaimer, gif_expansion_inputs > 0 OR pdf_expansion_inputs > 0 AS expansion_disclaimer FROM p"""))
def plan_diagnostics(spark, sf):
    return planning.plan_diagnostics(assets_jobs(spark, sf), derive(spark, sf, "jobs"))


@query(duck("assets jobs aj", EVERY_SQL + "SELECT job_id, work_items, eligible_inputs, work_items + eligible_inputs AS total_work_items FROM p"))
def count_work_items(spark, sf):
    return planning.count_work_items(assets_jobs(spark, sf), derive(spark, sf, "jobs"))


@query(duck("assets jobs aj", PLAN_SQL + """
, l AS (SELECT job_id, unnest([CASE WHEN forced_background_inputs > 0 THEN forced_background_inputs || ' inputs get a solid background' END, CASE WHEN high_compression_risk THEN 'Strong compression may be visible' END,
   CASE WHEN large_frame_count > 0 THEN 'A GIF has ' || large_frame_count || ' frames' END, CASE WHEN model_enabled AND inputs > eligible_inputs THEN (inputs - eligible_inputs) || ' inputs skip the model stage' END,
   CASE WHEN locked_inputs > 0 THEN locked_inputs || ' locked documents are skipped' END]) AS warning, unnest(range(0, 5)) AS o FROM p)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY o) - 1 AS ord, warning FROM l WHERE warning IS NOT NULL"""))
def warning_list(spark, sf):
    return planning.plan_warnings(planning.build_plan(assets_jobs(spark, sf)))


@query(duck("layers", """
, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN trim(name) <> '' THEN 0 ELSE 1 END, ord, tie, tie2, tie3) AS i FROM layers WHERE NOT is_group_end)
SELECT doc_id, count(*) AS layers, count_if(NOT is_hidden) AS visible, count_if(is_hidden) AS hidden, count_if(is_group_start) AS groups, count_if(NOT is_group_start AND is_text) AS texts,
  count_if(NOT is_group_start AND NOT is_text AND is_shape) AS shapes, count_if(NOT is_group_start AND NOT is_text AND NOT is_shape) AS images, count_if(is_locked) AS locked,
  CASE WHEN max(width) > 0 THEN max(width) ELSE -1 END AS max_width, CASE WHEN max(height) > 0 THEN max(height) ELSE -1 END AS max_height, bool_or(NOT is_group_start AND is_text) AS has_text, bool_or(is_smart) AS has_smart,
  bool_or((NOT is_group_start AND NOT is_text AND is_shape) OR has_vector_path) AS has_vector, string_agg(name, ', ' ORDER BY i) FILTER (i <= 5 AND trim(name) <> '') AS sample_names FROM r GROUP BY doc_id"""))
def summarize_layers(spark, sf):
    return layers.summarize_layers(derive(spark, sf, "layers"), ["ord", "tie", "tie2", "tie3"]).withColumns({
        c: F.coalesce(c, F.lit(-1)) for c in ("max_width", "max_height")
    })


@query(duck("layers", """
SELECT doc_id, string_agg(DISTINCT l, ', ' ORDER BY l) AS compression FROM (SELECT doc_id, CASE compression_code WHEN 0 THEN 'Raw' WHEN 1 THEN 'RLE' WHEN 2 THEN 'ZIP' WHEN 3 THEN 'ZIP Prediction' END AS l FROM layers) GROUP BY doc_id"""))
def layer_compression(spark, sf):
    return layers.layer_compression(derive(spark, sf, "layers"))


@query(duck("frames", """
SELECT asset_id, count(*) AS frames, CASE WHEN count(*) > 1 THEN round(1000.0::DOUBLE / avg(duration_ms) FILTER (duration_ms > 0), 6) END AS fps FROM frames GROUP BY asset_id"""))
def frame_rate(spark, sf):
    return frames.frame_rate(derive(spark, sf, "frames")).withColumn("fps", rounded("fps"))


@query(duck("recognitions", """
SELECT image_id, round(CASE WHEN len(scores) > 0 THEN least(greatest(list_avg(scores), 0), 1) ELSE least(greatest(box_score, 0), 1) END, 6) AS confidence FROM recognitions"""))
def mean_confidence(spark, sf):
    return DT.mean_confidence(recognitions(spark, sf)).withColumn("confidence", rounded("confidence"))


POINTS_SQL = """
, points AS (SELECT image_id, seq AS detection, CAST(cx * 180 + tie % 40 AS DOUBLE) AS px, CAST(cy * 90 + tie2 % 25 AS DOUBLE) AS py, 200 + image_id % 100 AS image_width, 120 + image_id % 60 AS image_height,
    image_id % 20 AS offset_x, image_id % 10 AS offset_y FROM detections)
"""


@query(duck("detections", POINTS_SQL + """
SELECT image_id, detection, round(least(greatest((offset_x + (min(px) + max(px)) / 2) / image_width, 0), 1), 6) AS cx, round(least(greatest((offset_y + (min(py) + max(py)) / 2) / image_height, 0), 1), 6) AS cy
FROM points GROUP BY image_id, detection, image_width, image_height, offset_x, offset_y"""))
def detection_bbox(spark, sf):
    i = F.col("image_id")
    points = derive(spark, sf, "detections").select(
        "image_id", F.col("seq").alias("detection"), (F.col("cx") * 180 + F.col("tie") % 40).alias("px"),
        (F.col("cy") * 90 + F.col("tie2") % 25).alias("py"), (200 + i % 100).alias("image_width"),
        (120 + i % 60).alias("image_height"), (i % 20).alias("offset_x"), (i % 10).alias("offset_y"),
    )
    return DT.detection_bbox(points, ["image_id", "detection"]).withColumns({"cx": rounded("cx"), "cy": rounded("cy")})


SORT_KEYS = {"name": "lower(file_name)", "size": "size_bytes", "resolution": "width * height"}


def _sorted(mode: str):
    def run(spark, sf):
        return outcomes.sort_assets(derive(spark, sf, "assets"), mode).select(
            "asset_id", "file_name", "size_bytes", (F.col("width") * F.col("height")).alias("pixels")
        )

    return run


for _key, _sql in SORT_KEYS.items():
    for _way in ("asc", "desc"):
        _rows = f"SELECT asset_id, file_name, size_bytes, width * height AS pixels FROM assets ORDER BY {_sql} {_way}, asset_id"
        query(duck("assets", _rows), name=f"sort_assets_{_key}_{_way}")(_sorted(f"{_key}_{_way}"))


@query(duck("runs", "SELECT run_id, epoch_us(run_ts) AS run_us, trigger_source FROM runs ORDER BY run_ts DESC, run_id DESC LIMIT 12"))
def recent_runs(spark, sf):
    return outcomes.recent_runs(derive(spark, sf, "runs"), 12).select(
        "run_id", F.unix_micros(F.col("run_ts").cast("timestamp")).alias("run_us"), "trigger_source"
    )


@query(duck("work", "SELECT run_id, item_no, file_name, 'returned' AS reason FROM work WHERE failed"))
def ordered_failures(spark, sf):
    failed = outcomes.failures_of(derive(spark, sf, "work"), F.lit("returned"))
    return outcomes.ordered_failures(failed, ["run_id", "item_no"])
