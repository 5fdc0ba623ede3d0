"""Scans, sources and sinks (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetflow.fixtures import assets_jobs, derive, duck
from assetflow.operators.lookups import lock_skips
from assetflow.operators.sets import import_new as split_candidates
from assetflow.operators.sets import supported_inputs
from assetflow.plans.conversion import plan_destinations, route
from assetflow.plans.expand import expand_outputs
from assetflow.plans.outcomes import failures_of, summarize_batch
from assetflow.queries.base import query
from assetflow.session import scratch_path
from assetflow.sources import failure_log as logs
from assetflow.sources import headers, history, plan_sink, presets

INPUTS = "('.png','.jpg','.jpeg','.webp','.bmp','.gif','.tif','.tiff','.ico','.svg','.pdf','.psd','.exe','.lnk')"


@query(duck("assets", f"""
SELECT asset_id, path, size_bytes FROM assets WHERE lower(ext) IN {INPUTS}
QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY asset_id) = 1"""))
def scan_inputs(spark, sf):
    return supported_inputs(derive(spark, sf, "assets"), ["asset_id"]).select("asset_id", "path", "size_bytes")


@query(duck("assets", """
SELECT 'new' AS outcome, asset_id, path AS item, CAST(NULL AS VARCHAR) AS reason FROM fresh WHERE probe_ok
UNION ALL SELECT 'failed', -1, file_name, 'unreadable' FROM fresh WHERE NOT probe_ok""").replace(
    "SELECT 'new'", """, fresh AS (
  SELECT asset_id, path, file_name, size_bytes >= 400 AS probe_ok FROM assets a
  WHERE NOT EXISTS (SELECT 1 FROM assets k WHERE k.is_pdf AND lower(k.path) = lower(a.path))
  QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY asset_id) = 1)
SELECT 'new'""", 1))
def import_new(spark, sf):
    assets = derive(spark, sf, "assets")
    candidates = assets.select(
        "asset_id", "path", (F.col("size_bytes") >= 400).alias("probe_ok"), F.lit("unreadable").alias("reason")
    )
    fresh, failed = split_candidates(candidates, assets.filter("is_pdf"), ["asset_id"])
    return fresh.select(
        F.lit("new").alias("outcome"), "asset_id", F.col("path").alias("item"), F.lit(None).cast("string").alias("reason")
    ).unionByName(failed.select(
        F.lit("failed").alias("outcome"), F.lit(-1).cast("bigint").alias("asset_id"), F.col("file_name").alias("item"), "reason"
    ))


def _header_bytes(assets):
    """Header bytes as they would stand in each asset's file, from its known sizes."""
    be = lambda c, n: F.lpad(F.hex(c), n * 2, "0")
    le = lambda c, n: F.concat(*[F.substring(be(c, n), 2 * (n - i) - 1, 2) for i in range(n)])
    w, h, alpha = F.col("width"), F.col("height"), F.col("has_alpha")
    e = F.lower("ext")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(w, 4), be(h, 4), F.lit("08"), F.when(alpha, "06").otherwise("02"), F.lit("000000"))
    gif = F.concat(F.lit("474946383961"), le(w, 2), le(h, 2), F.lit("F70000"))
    bmp = F.concat(F.lit("424D" + "00" * 12 + "28000000"), le(w, 4), le(h, 4), F.lit("01001800"))
    psd = F.concat(F.lit("384250530001000000000000"), F.when(alpha, "0004").otherwise("0003"), be(h, 4), be(w, 4), F.lit("00080003"))
    digits = F.when(e == ".png", png).when(e == ".gif", gif).when(e == ".bmp", bmp).when(e == ".psd", psd).otherwise("FFD8FFE000104A464946")
    return assets.select("asset_id", F.unhex(digits).alias("content"))


@query(duck("assets", """
SELECT asset_id, k AS kind, CASE WHEN k IS NULL THEN -1 ELSE width END AS width, CASE WHEN k IS NULL THEN -1 ELSE height END AS height,
  CASE WHEN k = 'png' OR k = 'psd' THEN CASE WHEN has_alpha THEN 4 ELSE 3 END ELSE -1 END::BIGINT AS channels,
  CASE k WHEN 'bmp' THEN 24 WHEN 'png' THEN 8 WHEN 'gif' THEN 8 WHEN 'psd' THEN 8 ELSE -1 END::BIGINT AS bit_depth,
  CASE k WHEN 'png' THEN CASE WHEN has_alpha THEN 'RGBA' ELSE 'RGB' END WHEN 'gif' THEN 'Indexed' WHEN 'psd' THEN 'RGB' END AS color_mode,
  coalesce(CAST(CASE WHEN k = 'png' OR k = 'psd' THEN has_alpha END AS VARCHAR), 'unknown') AS has_alpha_channel,
  CASE WHEN k IS NULL THEN 'unreadable header' END AS reason
FROM (SELECT *, CASE lower(ext) WHEN '.png' THEN 'png' WHEN '.gif' THEN 'gif' WHEN '.bmp' THEN 'bmp' WHEN '.psd' THEN 'psd' END AS k FROM assets)"""))
def probe_headers(spark, sf):
    good, bad = headers.probe_headers(_header_bytes(derive(spark, sf, "assets")))
    rows = good.unionByName(bad, allowMissingColumns=True)
    numbers = {c: F.coalesce(c, F.lit(-1)) for c in ("width", "height", "channels", "bit_depth")}
    return rows.withColumns(numbers | {
        "has_alpha_channel": F.coalesce(F.col("has_alpha_channel").cast("string"), F.lit("unknown")),
    })


@query(duck("runs", """
SELECT run_id, epoch_us(run_ts) AS run_us, trigger_source, output_format, original_bytes, was_canceled FROM runs"""))
def history_store(spark, sf):
    parsed = history.from_json(history.to_json(derive(spark, sf, "runs")))
    return parsed.select(
        "run_id", F.unix_micros(F.col("run_ts").cast("timestamp")).alias("run_us"),
        "trigger_source", "output_format", "original_bytes", "was_canceled",
    )


@query(duck("runs", """
SELECT run_id, epoch_us(run_ts) AS run_us, trigger_source FROM runs ORDER BY run_ts DESC, run_id DESC LIMIT 12"""))
def history_files(spark, sf):
    """Append every run to a store on shared storage and load the newest dozen back."""
    path = scratch_path(spark, "history")
    history.append(derive(spark, sf, "runs"), path)
    return history.load(spark, path).select(
        "run_id", F.unix_micros(F.col("run_ts").cast("timestamp")).alias("run_us"), "trigger_source"
    )


LOG_SQL = duck("work runs", """
, s AS (SELECT w.run_id, count(*) AS n, count_if(failed) AS f, any_value(r.trigger_source) AS src, any_value(r.output_format) AS fmt, any_value(r.was_canceled) AS c, any_value(r.run_ts) AS ts
  FROM work w JOIN runs r ON w.run_id = r.run_id GROUP BY w.run_id HAVING count_if(failed) > 0),
heads AS (SELECT run_id, unnest(['Run report', 'at: ' || strftime(ts, '%Y-%m-%d %H:%M:%S'), 'started by: ' || src, 'to: ' || fmt, 'inputs: ' || n,
   'done: ' || n, 'good: ' || (n - f), 'bad: ' || f, 'stopped early: ' || CASE WHEN c THEN 'true' ELSE 'false' END, '', 'Inputs:']) AS line,
   unnest(range(1, 12)) AS line_no FROM s)
SELECT run_id, line_no, line FROM heads
UNION ALL SELECT w.run_id, 11 + row_number() OVER (PARTITION BY w.run_id ORDER BY item_no, file_name, l_suppkey, l_extendedprice, l_discount, l_tax), '- ' || folder || '/' || file_name
  FROM work w JOIN s ON w.run_id = s.run_id
UNION ALL SELECT run_id, n + 12 + i, CASE i WHEN 0 THEN '' ELSE 'Not converted:' END FROM s, (SELECT unnest([0, 1]) AS i)
UNION ALL SELECT w.run_id, 13 + n + row_number() OVER (PARTITION BY w.run_id ORDER BY lower(file_name), file_name, item_no, l_suppkey), '- ' || file_name || ': item ' || item_no || ' failed'
  FROM work w JOIN s ON w.run_id = s.run_id WHERE failed""")


@query(LOG_SQL)
def failure_log(spark, sf):
    work, runs = derive(spark, sf, "work"), derive(spark, sf, "runs")
    summary = summarize_batch(work, runs)
    inputs = work.withColumn("path", F.concat_ws("/", "folder", "file_name"))
    failed = failures_of(work, F.format_string("item %d failed", "item_no")).select("run_id", "file_name", "reason", "item_no")
    order = ["item_no", "file_name", "l_suppkey", "l_extendedprice", "l_discount", "l_tax"]
    return logs.failure_log(summary, inputs, failed, order, ["item_no"])


@query(duck("presets", """
, p AS (SELECT saved_at, trim(json_extract_string(body, '$.name')) AS name, coalesce(CAST(json_extract_string(body, '$.quality') AS BIGINT), 100) AS quality,
   coalesce(json_extract_string(body, '$.output_format'), 'png') AS output_format,
   CASE WHEN coalesce(json_extract_string(body, '$.model_code'), 'standard') IN ('retired_a', 'retired_b') THEN 'standard'
     ELSE coalesce(json_extract_string(body, '$.model_code'), 'standard') END AS model_code,
   coalesce(CAST(json_extract_string(body, '$.allow_overwrite') AS BOOLEAN), FALSE) AS allow_overwrite FROM presets)
SELECT min(saved_at) OVER (PARTITION BY lower(name)) AS position, name, quality, output_format, model_code, allow_overwrite,
  CAST(1280 AS BIGINT) AS resize_width, '#FFFFFFFF' AS svg_background_color
FROM p QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY saved_at DESC) = 1"""))
def preset_store(spark, sf):
    loaded = presets.load_presets(derive(spark, sf, "presets"), ["retired_a", "retired_b"])
    return presets.upsert(loaded).select(
        "position", "name", "quality", "output_format", "model_code", "allow_overwrite", "resize_width", "svg_background_color"
    )


@query(duck("assets jobs aj", f"""
SELECT job_id, output_format, count(*) AS outputs FROM (
  SELECT job_id, output_format, unnest(range(0, CASE
    WHEN is_pdf AND output_format = 'pdf' AND page_count > 1 AND pdf_doc_mode = 'split' THEN page_count
    WHEN is_pdf AND output_format <> 'pdf' AND page_count > 1 AND pdf_image_mode = 'all_pages' THEN page_count
    WHEN ext = '.gif' AND frame_count > 1 AND gif_mode = 'all' AND output_format <> 'gif' THEN frame_count ELSE 1 END)) AS i
  FROM aj WHERE NOT (is_encrypted AND NOT is_unlocked))
GROUP BY ALL"""), name="plan_sink")
def plan_sink_rows(spark, sf):
    """Write the planned outputs by job and format, read them back."""
    routed = lock_skips(route(assets_jobs(spark, sf)))
    outputs = expand_outputs(plan_destinations(routed, ["asset_id"]))
    path = scratch_path(spark, "plan")
    plan_sink.write_plan(outputs.select("job_id", "output_format", "asset_id", "output_no", "destination", "output_name"), path)
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("job_id").cast("bigint").alias("job_id"), "output_format").agg(F.count(F.lit(1)).alias("outputs"))
