"""Keyed look-ups and tiles (C), path requests (G1), model stage (L)."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.fixtures import assets_jobs, derive, duck
from assetflow.operators import lookups as L
from assetflow.operators import sets, tiles
from assetflow.plans import conversion, runs
from assetflow.queries.base import query
from assetflow.queries.rules import COLLIDE_SQL, EXT_SQL
from assetflow.session import scratch_path


@query(duck("assets", """
SELECT asset_id, job_id FROM assets a WHERE NOT EXISTS (SELECT 1 FROM assets f WHERE f.size_bytes < 400 AND f.job_id = a.job_id AND lower(f.path) = lower(a.path))"""))
def exclude_failed(spark, sf):
    assets = derive(spark, sf, "assets")
    failed = assets.filter(F.col("size_bytes") < 400).select("job_id", F.upper("path").alias("path"))
    return L.exclude_failed(assets, failed, ["job_id"]).select("asset_id", "job_id")


@query(duck("assets", """
, p AS (SELECT job_id, lower(path) AS k, max(CASE WHEN size_bytes > 2000 THEN '/model/' || lower(file_name) ELSE '  ' END) AS o FROM assets WHERE size_bytes > 1000 GROUP BY 1, 2)
SELECT asset_id, coalesce(CASE WHEN trim(o) <> '' THEN o END, path) AS actual_path FROM assets LEFT JOIN p ON lower(path) = k AND assets.job_id = p.job_id"""))
def input_overrides(spark, sf):
    assets = derive(spark, sf, "assets")
    made = assets.filter(F.col("size_bytes") > 1000).select(
        "job_id",
        F.upper("path").alias("path"),
        F.when(F.col("size_bytes") > 2000, F.concat(F.lit("/model/"), F.lower("file_name"))).otherwise("  ").alias("output_path"),
    )
    return L.input_overrides(assets, made, ["job_id"]).select("asset_id", "actual_path")


@query(duck("jobs", """
, m AS (SELECT model_code AS code, model_code = 'retired_a' AS retired, bool_or(allow_overwrite) AND model_code NOT IN ('unknown', 'retired_a', 'anime') AS available FROM jobs GROUP BY 1),
r AS (SELECT job_id, CASE WHEN m.retired THEN 'standard' ELSE model_code END AS requested_model FROM jobs LEFT JOIN m ON m.code = jobs.model_code),
t AS (SELECT job_id, requested_model, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.code = requested_model AND available) THEN requested_model
   WHEN EXISTS (SELECT 1 FROM m WHERE m.code = 'general' AND available) THEN 'general' END AS resolved_model FROM r)
SELECT job_id, requested_model, resolved_model, coalesce(requested_model <> resolved_model, FALSE) AS used_fallback, CASE WHEN resolved_model IS NULL THEN 'no model available' END AS model_error FROM t"""))
def resolve_model(spark, sf):
    jobs = derive(spark, sf, "jobs")
    models = jobs.groupBy("model_code").agg(F.bool_or("allow_overwrite").alias("seen")).select(
        "model_code", (F.col("model_code") == "retired_a").alias("retired"),
        (F.col("seen") & ~F.col("model_code").isin("unknown", "retired_a", "anime")).alias("available"),
    )
    return L.resolve_model(jobs, models).select("job_id", "requested_model", "resolved_model", "used_fallback", "model_error")


TILE_SQL = """
, pt AS (SELECT * FROM (VALUES (0, 2, 1), (1, 3, 1), (2, 1, 2), (3, 2, 2), (4, 3, 2)) t(pattern, cols, rws)),
cells AS (SELECT pattern, cols, rws, c, r, row_number() OVER (ORDER BY pattern, r, c) - 1 AS ord FROM pt, (SELECT unnest(range(0, 3)) AS c), (SELECT unnest(range(0, 2)) AS r) WHERE c < cols AND r < rws),
b AS (SELECT asset_id, ord, pattern, width, height, c, r, width / CAST(cols AS DOUBLE) AS cw, height / CAST(rws AS DOUBLE) AS ch FROM assets, cells),
o AS (SELECT *, greatest(18, CAST(round_even(cw * 0.16::DOUBLE, 0) AS BIGINT)) AS ox, greatest(18, CAST(round_even(ch * 0.16::DOUBLE, 0) AS BIGINT)) AS oy FROM b),
e AS (SELECT *, greatest(0, CAST(floor(c * cw) AS BIGINT) - ox) AS x0, least(width, CAST(ceil((c + 1) * cw) AS BIGINT) + ox) AS x1,
   greatest(0, CAST(floor(r * ch) AS BIGINT) - oy) AS y0, least(height, CAST(ceil((r + 1) * ch) AS BIGINT) + oy) AS y1 FROM o),
tiles AS (SELECT asset_id, ord, CAST(pattern AS BIGINT) AS pattern, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM e WHERE x1 > x0 AND y1 > y0)
"""


@query(duck("assets", TILE_SQL + "SELECT * FROM tiles"))
def tile_grid(spark, sf):
    return tiles.tile_grid(derive(spark, sf, "assets"))


SUPPRESS_SQL = "WITH RECURSIVE " + duck("assets", TILE_SQL).removeprefix("WITH ") + """
, seqd AS (SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY ord) AS i, {'x': x, 'y': y, 'w': w, 'h': h} AS r FROM tiles)
, walk AS (SELECT DISTINCT asset_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(x BIGINT, y BIGINT, w BIGINT, h BIGINT)[]) AS kept FROM seqd
  UNION ALL
  SELECT asset_id, i, CASE WHEN hit IS NULL THEN list_append(kept, r) WHEN r.w * r.h < kept[hit].w * kept[hit].h THEN list_concat(list_append(kept[1:hit - 1], r), kept[hit + 1:]) ELSE kept END FROM (
    SELECT w.asset_id, s.i, w.kept, s.r, list_filter(range(1, len(w.kept) + 1), lambda k: least(w.kept[k].x + w.kept[k].w, s.r.x + s.r.w) > greatest(w.kept[k].x, s.r.x) AND least(w.kept[k].y + w.kept[k].h, s.r.y + s.r.h) > greatest(w.kept[k].y, s.r.y)
      AND ((least(w.kept[k].x + w.kept[k].w, s.r.x + s.r.w) - greatest(w.kept[k].x, s.r.x)) * (least(w.kept[k].y + w.kept[k].h, s.r.y + s.r.h) - greatest(w.kept[k].y, s.r.y))) / CAST(least(w.kept[k].w * w.kept[k].h, s.r.w * s.r.h) AS DOUBLE) >= 0.75)[1] AS hit
    FROM walk w JOIN seqd s ON s.asset_id = w.asset_id AND s.i = w.i + 1))
SELECT asset_id, slot - 1 AS slot, kept[slot].x AS x, kept[slot].y AS y, kept[slot].w AS w, kept[slot].h AS h FROM (
  SELECT asset_id, kept, unnest(range(1, len(kept) + 1)) AS slot FROM (SELECT asset_id, arg_max(kept, i) AS kept FROM walk GROUP BY 1))"""


@query(SUPPRESS_SQL)
def suppress_overlaps(spark, sf):
    return tiles.suppress_overlaps(tiles.tile_grid(derive(spark, sf, "assets")))


@query(duck("assets", """
SELECT path FROM (SELECT part, ord, trim(path) AS path FROM (SELECT 0 AS part, asset_id AS ord, CASE WHEN has_alpha THEN path ELSE '  ' END AS path FROM assets
  UNION ALL SELECT 1, asset_id, ' ' || upper(path) FROM assets) WHERE trim(path) <> '')
QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY part, ord, path) = 1"""))
def merge_path_requests(spark, sf):
    assets = derive(spark, sf, "assets")
    first = assets.select(F.col("asset_id").alias("ord"), F.when(F.col("has_alpha"), F.col("path")).otherwise("  ").alias("path"))
    second = assets.select(F.col("asset_id").alias("ord"), F.concat(F.lit(" "), F.upper("path")).alias("path"))
    return sets.merge_path_requests(first, second)


def _stub_model(rows, model: str, device: str) -> list[str]:
    """Stands in for a user's model: small images cannot be read."""
    if (rows[["width", "height"]].min(axis=1) < 200).any():
        raise ValueError("image too small")
    return [f"/model/{model}/{name.lower()}" for name in rows["file_name"]]


@query(duck("assets jobs", """
, e AS (SELECT *, least(width, height) < 200 AS bad FROM assets WHERE job_id IN (SELECT job_id FROM jobs WHERE model_stage) AND NOT is_pdf AND frame_count <= 1 AND lower(ext) IN ('.jpg','.jpeg','.png','.webp','.bmp','.tif','.tiff','.gif'))
SELECT job_id, path, CASE WHEN NOT bad THEN '/model/standard/' || lower(file_name) END AS output_path, CASE WHEN bad THEN 'image too small' END AS reason FROM e"""))
def model_stage(spark, sf):
    stage = conversion.model_stage(derive(spark, sf, "assets"), _stub_model, derive(spark, sf, "jobs"))
    done = stage.results.select("job_id", "path", "output_path", F.lit(None).cast("string").alias("reason"))
    return done.unionByName(
        stage.failures.select("job_id", "path", F.lit(None).cast("string").alias("output_path"), "reason")
    )


ELIGIBLE = "job_id IN (SELECT job_id FROM jobs WHERE model_stage) AND NOT is_pdf AND frame_count <= 1 AND lower(ext) IN ('.jpg','.jpeg','.png','.webp','.bmp','.tif','.tiff','.gif')"
RUN_SQL = COLLIDE_SQL.replace("\n, named AS", f"""
, early AS (SELECT job_id, path, file_name, lower(path) AS k FROM assets WHERE {ELIGIBLE} AND least(width, height) < 200)
, rest AS (SELECT * FROM rt WHERE NOT EXISTS (SELECT 1 FROM early WHERE early.job_id = rt.job_id AND early.k = lower(rt.path)))
, named AS""", 1).replace("FROM rt) WHERE NOT", "FROM rest) WHERE NOT", 1).rsplit("SELECT n.asset_id, n.job_id", 1)[0] + f"""
, placed AS (SELECT r.*, n.folder || '/' || n.base_name || CASE WHEN coalesce(w.slot, 0) > 0 THEN '(' || w.slot || ')' ELSE '' END || n.ext_out AS destination, n.ext_out = '' AS inside, n.folder AS parent
  FROM named n JOIN rest r ON r.asset_id = n.asset_id LEFT JOIN (SELECT * FROM walk WHERE asset_id IS NOT NULL) w ON w.asset_id = n.asset_id)
, outs AS (SELECT job_id, path, strategy, destination, inside, parent, i + 1 AS output_no, destination || CASE WHEN NOT inside THEN '' ELSE
    CASE WHEN strategy IN ('pdf_split','pdf_pages') THEN '/page_' || (i + 1) WHEN strategy = 'gif_specific_pdf' THEN '/frame_' || (frame_index + 1) ELSE '/frame_' || (i + 1) END
    || CASE WHEN strategy = 'pdf_split' THEN '.pdf' ELSE {EXT_SQL} END END AS item
  FROM (SELECT *, unnest(range(0, CASE WHEN strategy IN ('pdf_split','pdf_pages') THEN greatest(page_count, 1) WHEN strategy IN ('gif_pdf_frames','gif_frames') THEN greatest(frame_count, 1) ELSE 1 END)) AS i FROM placed))
, fails AS (SELECT job_id, path, file_name, 'image too small' AS reason FROM early
  UNION ALL SELECT job_id, path, file_name, 'locked' FROM rest WHERE is_encrypted AND NOT is_unlocked)
, counts AS (SELECT j.job_id, any_value(j.output_format) AS fmt, any_value(j.compression_mode) AS comp, any_value(j.quality) AS q, any_value(j.resize_mode) AS rs, any_value(j.gif_mode) AS gm,
    count(a.job_id) AS n, coalesce(any_value(f.bad), 0) AS bad, coalesce(sum(a.size_bytes), 0)::BIGINT AS bytes
  FROM jobs j LEFT JOIN assets a ON a.job_id = j.job_id LEFT JOIN (SELECT job_id, count(*) AS bad FROM fails GROUP BY 1) f ON f.job_id = j.job_id GROUP BY 1)
, heads AS (SELECT job_id, unnest(['Run report', 'at: 2024-05-06 07:08:09', 'started by: watch', 'to: ' || fmt, 'compression: ' || comp, 'quality: ' || q, 'resizing: ' || rs, 'animations: ' || gm, 'inputs: ' || n,
    'done: ' || n, 'good: ' || (n - bad), 'bad: ' || bad, 'stopped early: false', 'took: 01:30.50', '', 'Inputs:']) AS line, unnest(range(1, 17)) AS line_no FROM counts WHERE bad > 0)
SELECT 'output' AS part, job_id, output_no AS n, item, path || ' ' || strategy AS detail FROM outs
UNION ALL SELECT 'failure', job_id, 0, path, file_name || ': ' || reason FROM fails
UNION ALL SELECT DISTINCT 'directory', job_id, 0, CASE WHEN inside THEN destination ELSE parent END, '' FROM outs
UNION ALL SELECT 'history', job_id, n, fmt, (n - bad) || ' ' || bad || ' ' || bytes FROM counts
UNION ALL SELECT 'log', job_id, line_no, line, '' FROM heads
UNION ALL SELECT 'log', a.job_id, 16 + row_number() OVER (PARTITION BY a.job_id ORDER BY asset_id), '- ' || path, '' FROM assets a JOIN counts c ON c.job_id = a.job_id WHERE c.bad > 0
UNION ALL SELECT 'log', job_id, 17 + n + i, CASE i WHEN 0 THEN '' ELSE 'Not converted:' END, '' FROM counts, (SELECT unnest([0, 1]) AS i) WHERE bad > 0
UNION ALL SELECT 'log', f.job_id, 18 + n + row_number() OVER (PARTITION BY f.job_id ORDER BY lower(file_name), file_name, path, reason), '- ' || file_name || ': ' || reason, '' FROM fails f JOIN counts c ON c.job_id = f.job_id"""


@query(RUN_SQL)
def conversion_run(spark, sf):
    """A run of every job, committed as a whole and read back: every output, failure, folder, history row and line of the
    log.  The model stage comes first, and the input files are on disk already.  A first attempt of the run, which stops
    after its failures, leaves nothing to the reader."""
    assets, jobs = derive(spark, sf, "assets"), derive(spark, sf, "jobs")
    existing = assets.select(F.concat(F.lit("/in/"), "source").alias("folder"), "file_name")
    stage = conversion.model_stage(assets, _stub_model, jobs)
    store = runs.RunStore(spark, scratch_path(spark, "runs"))
    store.begin("all").write("failures", stage.failures)
    started = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)
    runs.commit_run(
        store, "all", assets, jobs, ["asset_id"], derive(spark, sf, "overrides"), existing, stage,
        trigger_source="watch", started=started, finished=started + timedelta(seconds=90.5),
    )
    no, none = F.lit(0).cast("bigint"), F.lit("")
    parts = {
        "output": store.read("outputs").select("job_id", F.col("output_no").alias("n"), F.col("output_path").alias("item"), F.concat_ws(" ", "path", "strategy").alias("detail")),
        "failure": store.read("failures").select("job_id", no.alias("n"), F.col("path").alias("item"), F.concat("file_name", F.lit(": "), "reason").alias("detail")),
        "directory": store.read("directories").select("job_id", no.alias("n"), F.col("folder").alias("item"), none.alias("detail")),
        "history": store.read("history").select(
            "job_id", F.col("total_count").alias("n"), F.col("output_format").alias("item"), F.concat_ws(" ", "success_count", "failure_count", "original_bytes").alias("detail")
        ),
        "log": store.read("log").select("job_id", F.col("line_no").alias("n"), F.col("line").alias("item"), none.alias("detail")),
    }
    return reduce(DataFrame.unionByName, [rows.select(F.lit(part).alias("part"), "*") for part, rows in parts.items()])
