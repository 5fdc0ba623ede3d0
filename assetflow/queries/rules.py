"""Option rules, planning columns, expansion and naming (B, E1, E2, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetflow.fixtures import assets_jobs, derive, duck
from assetflow.functions import geometry as G
from assetflow.functions import naming as N
from assetflow.functions import options as O
from assetflow.functions.display import progress_percent, remaining_count, run_status, sub_item
from assetflow.operators.lookups import apply_overrides as with_overrides
from assetflow.operators.lookups import lock_skips
from assetflow.operators.numbering import batch_index as with_index
from assetflow.operators.sets import allowed_formats as formats_of
from assetflow.plans import conversion, expand
from assetflow.plans.outcomes import summarize_batch
from assetflow.plans.planning import clamp_selection as with_selection
from assetflow.queries.base import query, rounded

# options with every value forced into range, as the oracles need them too
NORM = """, nj AS (SELECT * EXCLUDE (quality, resize_width, resize_height, resize_percent, rename_start, rename_digits, auto_folder, svg_background_color, icon_background_color, language_code, gif_frame_index, pdf_page_index),
  least(greatest(quality, 1), 100) AS quality, greatest(resize_width, 1) AS resize_width, greatest(resize_height, 1) AS resize_height,
  least(greatest(resize_percent, 1), 1000) AS resize_percent, greatest(rename_start, 0) AS rename_start, least(greatest(rename_digits, 1), 8) AS rename_digits,
  CASE WHEN trim(auto_folder) = '' THEN 'converted' ELSE trim(auto_folder) END AS auto_folder,
  CASE WHEN trim(svg_background_color) = '' THEN '#FFFFFFFF' ELSE svg_background_color END AS svg_background_color,
  CASE WHEN trim(icon_background_color) = '' THEN '#FFFFFFFF' ELSE icon_background_color END AS icon_background_color,
  CASE WHEN trim(language_code) = '' THEN 'en-US' ELSE language_code END AS language_code,
  greatest(gif_frame_index, 0) AS gif_frame_index, greatest(pdf_page_index, 0) AS pdf_page_index FROM jobs)
, naj AS (SELECT a.*, j.* EXCLUDE (job_id) FROM assets a JOIN nj j ON a.job_id = j.job_id)
"""


def normalized_plan(spark, sf):
    return derive(spark, sf, "assets").join(O.normalize_options(derive(spark, sf, "jobs")), "job_id")


@query(duck("assets jobs", NORM + """
SELECT job_id, quality, resize_width, resize_height, resize_percent, rename_start, rename_digits, auto_folder, svg_background_color,
  icon_background_color, language_code, gif_frame_index, pdf_page_index FROM nj"""))
def normalize_options(spark, sf):
    return O.normalize_options(derive(spark, sf, "jobs")).select(
        "job_id", "quality", "resize_width", "resize_height", "resize_percent", "rename_start", "rename_digits", "auto_folder",
        "svg_background_color", "icon_background_color", "language_code", "gif_frame_index", "pdf_page_index",
    )


@query(duck("jobs", """
SELECT job_id, CAST(CASE compression_mode WHEN 'high_quality' THEN 92 WHEN 'balanced' THEN 80 WHEN 'high_compression' THEN 60 ELSE least(greatest(quality, 1), 100) END AS BIGINT) AS quality,
  CAST(CASE compression_mode WHEN 'high_quality' THEN 100 WHEN 'balanced' THEN 80 WHEN 'high_compression' THEN 60 ELSE least(greatest(quality, 1), 100) END AS BIGINT) AS gif_quality FROM jobs"""))
def resolve_quality(spark, sf):
    return derive(spark, sf, "jobs").select(
        "job_id", O.resolve_quality().alias("quality"), O.resolve_quality(gif=True).alias("gif_quality")
    )


DIMS_SQL = """
  CASE resize_mode WHEN 'fixed_width' THEN greatest(1, resize_width) WHEN 'custom_size' THEN greatest(1, resize_width)
    WHEN 'fixed_height' THEN greatest(1, CAST(round_even(width * (resize_height / CAST(height AS DOUBLE)), 0) AS BIGINT))
    WHEN 'scale_percent' THEN greatest(1, CAST(round_even(width * resize_percent / 100.0::DOUBLE, 0) AS BIGINT)) ELSE width END AS target_width,
  CASE resize_mode WHEN 'fixed_height' THEN greatest(1, resize_height) WHEN 'custom_size' THEN greatest(1, resize_height)
    WHEN 'fixed_width' THEN greatest(1, CAST(round_even(height * (resize_width / CAST(width AS DOUBLE)), 0) AS BIGINT))
    WHEN 'scale_percent' THEN greatest(1, CAST(round_even(height * resize_percent / 100.0::DOUBLE, 0) AS BIGINT)) ELSE height END AS target_height"""


@query(duck("assets jobs aj", f"SELECT asset_id, job_id, {DIMS_SQL} FROM aj"))
def target_dimensions(spark, sf):
    w, h = G.target_dimensions()
    return assets_jobs(spark, sf).select("asset_id", "job_id", w.alias("target_width"), h.alias("target_height"))


EXT_SQL = "CASE output_format WHEN 'jpeg' THEN '.jpg' ELSE '.' || output_format END"


@query(duck("jobs", f"SELECT job_id, {EXT_SQL} AS extension, output_format NOT IN ('jpeg','gif','pdf') AS alpha_ok FROM jobs"))
def format_metadata(spark, sf):
    return derive(spark, sf, "jobs").select(
        "job_id", O.output_extension().alias("extension"), O.supports_alpha().alias("alpha_ok")
    )


@query(duck("assets jobs", NORM + """
SELECT asset_id, job_id, CASE WHEN e IN ('.exe','.lnk') THEN opq OR NOT icon_use_transparency WHEN e = '.psd' AND NOT has_alpha THEN FALSE ELSE svg_use_background OR opq END AS use_background,
  CASE WHEN e IN ('.exe','.lnk') THEN icon_background_color WHEN e = '.svg' THEN svg_background_color WHEN e = '.psd' AND NOT has_alpha THEN '#FFFFFFFF'
    WHEN e = '.psd' OR svg_use_background OR opq THEN svg_background_color ELSE '#FFFFFFFF' END AS background_color,
  CASE WHEN e = '.psd' THEN TRUE WHEN e IN ('.exe','.lnk') THEN opq OR NOT icon_use_transparency ELSE svg_use_background OR opq END AS pdf_use_background
FROM (SELECT *, lower(ext) AS e, output_format IN ('jpeg','gif','pdf') AS opq FROM naj)"""))
def resolve_background(spark, sf):
    use, colour = O.resolve_background()
    pdf_use, _ = O.resolve_pdf_background()
    return normalized_plan(spark, sf).select(
        "asset_id", "job_id", use.alias("use_background"), colour.alias("background_color"), pdf_use.alias("pdf_use_background")
    )


BASE_SQL = r"""CASE rename_mode WHEN 'number' THEN lpad(CAST(rename_start + batch_index AS VARCHAR), greatest(CAST(rename_digits AS INT), CAST(length(CAST(rename_start + batch_index AS VARCHAR)) AS INT)), '0')
  WHEN 'prefix' THEN regexp_replace(rename_prefix, '[\x00-\x1F"<>|:*?\\/]', '', 'g') || stem WHEN 'suffix' THEN stem || regexp_replace(rename_suffix, '[\x00-\x1F"<>|:*?\\/]', '', 'g') ELSE stem END"""
INDEX_SQL = ", idx AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY asset_id) - 1 AS batch_index FROM naj)"


@query(duck("assets jobs", NORM + INDEX_SQL + f"SELECT asset_id, job_id, batch_index, {BASE_SQL} AS base_name FROM idx"))
def output_base_name(spark, sf):
    return with_index(normalized_plan(spark, sf), ["asset_id"]).select(
        "asset_id", "job_id", "batch_index", N.output_base_name().alias("base_name")
    )


FOLDER_SQL = """CASE folder_rule WHEN 'specific' THEN CASE WHEN trim(output_directory) = '' THEN '/in/' || source ELSE output_directory END
  WHEN 'auto' THEN CASE WHEN trim(output_directory) = '' THEN '/in/' || source ELSE output_directory END || '/' || auto_folder ELSE '/in/' || source END"""


@query(duck("assets jobs", NORM + f"SELECT asset_id, job_id, {FOLDER_SQL} AS folder FROM naj"))
def output_folder(spark, sf):
    return normalized_plan(spark, sf).select("asset_id", "job_id", N.output_folder().alias("folder"))


@query(duck("assets jobs", NORM + """
SELECT DISTINCT job_id, """ + FOLDER_SQL + " AS folder FROM naj"))
def output_directories(spark, sf):
    from assetflow.plans.planning import output_directories as directories

    return directories(normalized_plan(spark, sf))


OVERRIDE_COLUMNS = ["sel_page", "sel_frame", "page_from", "page_to", "frame_from", "frame_to"]
SELECT_SQL = """, ov AS (SELECT job_id, lower(path_key) AS k, arg_max(CASE WHEN kind = 'page' THEN start_index END, CASE WHEN kind = 'page' THEN asset_id END) AS sel_page,
    arg_max(CASE WHEN kind = 'frame' THEN start_index END, CASE WHEN kind = 'frame' THEN asset_id END) AS sel_frame,
    arg_max(CASE WHEN kind = 'page_range' THEN start_index END, CASE WHEN kind = 'page_range' THEN asset_id END) AS page_from,
    arg_max(CASE WHEN kind = 'page_range' THEN end_index END, CASE WHEN kind = 'page_range' THEN asset_id END) AS page_to,
    arg_max(CASE WHEN kind = 'frame_range' THEN start_index END, CASE WHEN kind = 'frame_range' THEN asset_id END) AS frame_from,
    arg_max(CASE WHEN kind = 'frame_range' THEN end_index END, CASE WHEN kind = 'frame_range' THEN asset_id END) AS frame_to
  FROM overrides GROUP BY 1, 2),
oaj AS (SELECT naj.*, sel_page, sel_frame, page_from, page_to, frame_from, frame_to FROM naj LEFT JOIN ov ON naj.job_id = ov.job_id AND lower(naj.path) = ov.k)
, sel AS (SELECT *, least(greatest(coalesce(sel_page, pdf_page_index), 0), greatest(page_count - 1, 0)) AS page_index,
    least(greatest(coalesce(sel_frame, gif_frame_index), 0), greatest(frame_count - 1, 0)) AS frame_index,
    least(greatest(coalesce(page_from, 0), 0), greatest(page_count - 1, 0)) AS page_start,
    least(greatest(coalesce(page_to, page_count), least(greatest(coalesce(page_from, 0), 0), greatest(page_count - 1, 0))), greatest(page_count - 1, 0)) AS page_end,
    least(greatest(coalesce(frame_from, 0), 0), greatest(frame_count - 1, 0)) AS frame_start,
    least(greatest(coalesce(frame_to, frame_count), least(greatest(coalesce(frame_from, 0), 0), greatest(frame_count - 1, 0))), greatest(frame_count - 1, 0)) AS frame_end,
    CASE WHEN page_count <= 1 THEN 'current_page' ELSE pdf_image_mode END AS image_mode, CASE WHEN page_count <= 1 THEN 'all_pages' ELSE pdf_doc_mode END AS document_mode
  FROM oaj)
"""


@query(duck("assets jobs overrides", NORM + SELECT_SQL + "SELECT asset_id, job_id, "
    + ", ".join(f"coalesce({c}, -99) AS {c}" for c in OVERRIDE_COLUMNS) + " FROM oaj"))
def apply_overrides(spark, sf):
    return with_overrides(normalized_plan(spark, sf), derive(spark, sf, "overrides")).select(
        "asset_id", "job_id", *[F.coalesce(c, F.lit(-99)).alias(c) for c in OVERRIDE_COLUMNS]
    )


@query(duck("assets jobs overrides", NORM + SELECT_SQL + """
SELECT asset_id, job_id, page_index, frame_index, page_start, page_end, frame_start, frame_end, image_mode, document_mode FROM sel"""))
def clamp_selection(spark, sf):
    return with_selection(with_overrides(normalized_plan(spark, sf), derive(spark, sf, "overrides"))).select(
        "asset_id", "job_id", "page_index", "frame_index", "page_start", "page_end", "frame_start", "frame_end", "image_mode", "document_mode"
    )


ROUTE_SQL = """, rt AS (SELECT *, CASE WHEN e = '.pdf' AND output_format = 'pdf' AND document_mode = 'split' THEN 'pdf_split' WHEN e = '.pdf' AND output_format = 'pdf' THEN 'pdf_document'
    WHEN e = '.pdf' AND page_count > 1 AND image_mode = 'all_pages' THEN 'pdf_pages' WHEN e = '.pdf' THEN 'pdf_page'
    WHEN e = '.gif' AND output_format = 'pdf' AND frame_count > 1 AND gif_mode = 'all' THEN 'gif_pdf_frames' WHEN e = '.gif' AND output_format = 'pdf' AND frame_count > 1 AND gif_mode = 'specific' THEN 'gif_specific_pdf'
    WHEN output_format = 'pdf' THEN 'source_to_pdf' WHEN e = '.gif' AND gif_mode = 'all' AND frame_count > 1 AND output_format <> 'gif' THEN 'gif_frames'
    WHEN e = '.gif' AND gif_mode = 'specific' AND output_format <> 'gif' THEN 'gif_specific' WHEN output_format = 'svg' THEN 'svg' WHEN e = '.gif' AND output_format = 'gif' THEN 'animated_gif' ELSE 'raster' END AS strategy
  FROM (SELECT *, lower(ext) AS e FROM sel))
"""


@query(duck("assets jobs overrides", NORM + SELECT_SQL + ROUTE_SQL + "SELECT asset_id, job_id, strategy FROM rt"))
def route_conversion(spark, sf):
    return conversion.route(normalized_plan(spark, sf), derive(spark, sf, "overrides")).select("asset_id", "job_id", "strategy")


@query(duck("assets jobs overrides", NORM + SELECT_SQL + ROUTE_SQL + f"""
SELECT asset_id, job_id, strategy, i + 1 AS output_no, CASE WHEN n > 1 OR strategy IN ('pdf_split','pdf_pages') THEN i ELSE lo END AS page_from,
  CASE WHEN n > 1 OR strategy IN ('pdf_split','pdf_pages') THEN i ELSE hi END AS page_to,
  CASE WHEN strategy = 'pdf_split' THEN 'page_' || (i + 1) || '.pdf' WHEN strategy = 'pdf_pages' THEN 'page_' || (i + 1) || {EXT_SQL} END AS output_name
FROM (SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, CASE WHEN strategy IN ('pdf_split','pdf_pages') THEN page_count ELSE 1 END AS n,
    CASE WHEN strategy = 'pdf_page' OR document_mode = 'current_page' THEN page_index WHEN document_mode = 'page_range' THEN page_start ELSE 0 END AS lo,
    CASE WHEN strategy = 'pdf_page' OR document_mode = 'current_page' THEN page_index WHEN document_mode = 'page_range' THEN page_end ELSE page_count - 1 END AS hi
  FROM rt WHERE strategy IN ('pdf_split','pdf_document','pdf_pages','pdf_page')))"""))
def expand_pages(spark, sf):
    routed = conversion.route(normalized_plan(spark, sf), derive(spark, sf, "overrides"))
    return expand.expand_pages(routed).select(
        "asset_id", "job_id", "strategy", "output_no", "page_from", "page_to", "output_name"
    )


@query(duck("assets jobs overrides", NORM + SELECT_SQL + ROUTE_SQL + f"""
SELECT asset_id, job_id, strategy, i + 1 AS output_no, CASE WHEN strategy IN ('gif_pdf_frames','gif_frames') THEN i WHEN strategy IN ('gif_specific_pdf','gif_specific') THEN frame_index ELSE -1 END AS frame_no,
  CASE WHEN strategy IN ('gif_pdf_frames','gif_frames') THEN 'frame_' || (i + 1) || {EXT_SQL} WHEN strategy = 'gif_specific_pdf' THEN 'frame_' || (frame_index + 1) || {EXT_SQL} END AS output_name
FROM (SELECT *, unnest(range(0, CASE WHEN strategy IN ('gif_pdf_frames','gif_frames') THEN frame_count ELSE 1 END)) AS i FROM rt WHERE e = '.gif')"""))
def expand_frames(spark, sf):
    routed = conversion.route(normalized_plan(spark, sf), derive(spark, sf, "overrides"))
    return expand.expand_frames(routed).select("asset_id", "job_id", "strategy", "output_no", F.coalesce("frame_no", F.lit(-1)).alias("frame_no"), "output_name")


@query(duck("assets jobs overrides", NORM + SELECT_SQL + f"""
, g AS (SELECT *, frame_count > 1 AND same AND gq >= 100 AND frame_start = 0 AND frame_end = frame_count - 1 AS is_passthrough FROM (
   SELECT *, {DIMS_SQL}, resize_mode = 'none' AS same,
     CASE compression_mode WHEN 'high_quality' THEN 100 WHEN 'balanced' THEN 80 WHEN 'high_compression' THEN 60 ELSE quality END AS gq FROM sel WHERE ext = '.gif' AND output_format = 'gif'))
SELECT asset_id, job_id, is_passthrough, unnest(CASE WHEN is_passthrough THEN [-1] ELSE range(frame_start, frame_end + 1) END) AS frame_no FROM g"""))
def trim_frames(spark, sf):
    from assetflow.operators.frames import trim_frames as trimmed

    plan = with_overrides(normalized_plan(spark, sf), derive(spark, sf, "overrides"))
    return trimmed(plan).select("asset_id", "job_id", "is_passthrough", F.coalesce("frame_no", F.lit(-1)).alias("frame_no"))


@query(duck("assets jobs", """
SELECT asset_id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY lower(path), asset_id) - 1 AS batch_index FROM assets"""))
def batch_index(spark, sf):
    return with_index(derive(spark, sf, "assets"), [F.lower("path"), "asset_id"]).select("asset_id", "job_id", "batch_index")


COLLIDE_SQL = "WITH RECURSIVE " + duck("assets jobs overrides", NORM + SELECT_SQL + ROUTE_SQL).removeprefix("WITH ") + f"""
, named AS (SELECT asset_id, job_id, batch_index AS seq, allow_overwrite, {FOLDER_SQL} AS folder, {BASE_SQL} AS base_name,
    CASE WHEN strategy IN ('pdf_split','pdf_pages','gif_pdf_frames','gif_specific_pdf','gif_frames') THEN '' ELSE {EXT_SQL} END AS ext_out
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY asset_id) - 1 AS batch_index FROM rt) WHERE NOT (is_encrypted AND NOT is_unlocked))
, items AS (SELECT *, lower(folder) AS f, lower(base_name) AS b, lower(ext_out) AS x, regexp_replace(lower(base_name), '(\\([1-9][0-9]*\\))+$', '') AS root FROM named WHERE NOT (allow_overwrite AND ext_out <> ''))
, grouped AS (SELECT *, dense_rank() OVER (ORDER BY job_id, f, x, root) AS gid, row_number() OVER (PARTITION BY job_id, f, x, root ORDER BY seq) AS i FROM items)
, held AS (SELECT '/in/' || source AS f, list(DISTINCT lower(file_name)) AS names FROM assets GROUP BY 1)
, walk AS (SELECT DISTINCT gid, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS BIGINT) AS asset_id, CAST(NULL AS BIGINT) AS slot FROM grouped
  UNION ALL
  SELECT gid, i, list_append(taken, b || CASE WHEN slot > 0 THEN '(' || slot || ')' ELSE '' END || x), asset_id, slot FROM (
    SELECT w.gid, g.i, w.taken, g.asset_id, g.b, g.x, list_filter(range(0, g.i + len(coalesce(h.names, [])) + 2), lambda k: NOT list_contains(w.taken, g.b || CASE WHEN k > 0 THEN '(' || k || ')' ELSE '' END || g.x)
      AND NOT list_contains(coalesce(h.names, []), g.b || CASE WHEN k > 0 THEN '(' || k || ')' ELSE '' END || g.x))[1] AS slot
    FROM walk w JOIN grouped g ON g.gid = w.gid AND g.i = w.i + 1 LEFT JOIN held h ON h.f = g.f))
SELECT n.asset_id, n.job_id, coalesce(w.slot, 0) AS slot, n.folder || '/' || n.base_name || CASE WHEN coalesce(w.slot, 0) > 0 THEN '(' || w.slot || ')' ELSE '' END || n.ext_out AS destination
FROM named n LEFT JOIN (SELECT * FROM walk WHERE asset_id IS NOT NULL) w ON w.asset_id = n.asset_id"""


@query(COLLIDE_SQL)
def resolve_collisions(spark, sf):
    """Names of all planned outputs; the input files themselves are on disk already."""
    routed = lock_skips(conversion.route(normalized_plan(spark, sf), derive(spark, sf, "overrides")))
    existing = derive(spark, sf, "assets").select(F.concat(F.lit("/in/"), "source").alias("folder"), "file_name")
    return conversion.plan_destinations(routed, ["asset_id"], existing).select("asset_id", "job_id", "slot", "destination")


@query(duck("work runs", """
, s AS (SELECT r.run_id, any_value(was_canceled) AS c, count(w.run_id) AS n, count_if(coalesce(failed, FALSE)) AS f, coalesce(max(w.work_items), 0) AS m FROM runs r LEFT JOIN work w ON w.run_id = r.run_id GROUP BY 1)
SELECT run_id, CASE WHEN c THEN 'canceled' WHEN f > 0 THEN 'completed_with_failures' ELSE 'completed' END AS status,
  CASE WHEN m = 0 THEN 0.0 ELSE round(least(greatest(100.0::DOUBLE * n / m, 0), 100), 6) END AS percent, greatest(m - n, 0) AS remaining,
  CASE WHEN m > 1 AND c THEN least(n, m) ELSE -1 END AS sub_index, CASE WHEN m > 1 AND c THEN m ELSE -1 END AS sub_count FROM s"""), name="run_status")
def run_status_rows(spark, sf):
    totals = derive(spark, sf, "work").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failure_count"), F.max("work_items").alias("m")
    )
    runs = derive(spark, sf, "runs").join(totals, "run_id", "left").na.fill(0, ["n", "failure_count", "m"])
    fmt = F.when(F.col("was_canceled"), "pdf").otherwise("png")
    index, count = sub_item(fmt, F.lit("walk.GIF"), F.col("n"), F.col("m"))
    return runs.select(
        "run_id", run_status().alias("status"), rounded(progress_percent(F.col("n"), F.col("m"))).alias("percent"),
        remaining_count(F.col("n"), F.col("m")).alias("remaining"), F.coalesce(index, F.lit(-1)).alias("sub_index"), F.coalesce(count, F.lit(-1)).alias("sub_count"),
    )


@query(duck("profiles", """
SELECT profile_id, starts_with(a, b) OR starts_with(b, a) AS overlaps,
  CASE WHEN trim(input_directory) = '' THEN 'invalid_input' WHEN trim(output_directory) = '' THEN 'invalid_output' WHEN starts_with(a, b) OR starts_with(b, a) THEN 'overlap' END AS problem
FROM (SELECT *, lower(input_directory) || '/' AS a, lower(output_directory) || '/' AS b FROM profiles)"""))
def paths_overlap(spark, sf):
    return N.validate_profiles(derive(spark, sf, "profiles")).select("profile_id", "overlaps", "problem")


@query(duck("jobs", """
SELECT job_id, output_format IN ('jpeg','webp') AND (compression_mode = 'high_compression' OR (compression_mode = 'custom' AND quality <= 45)) AS risky FROM jobs"""))
def compression_risk(spark, sf):
    return derive(spark, sf, "jobs").select("job_id", O.compression_risk().alias("risky"))


@query(duck("assets jobs aj", """
SELECT asset_id, job_id, CASE WHEN frame_count > 1 AND output_format <> 'gif' THEN 'all' ELSE gif_mode END AS gif_mode,
  CASE WHEN frame_count > 1 AND output_format <> 'gif' THEN 0 ELSE gif_frame_index END AS gif_frame_index,
  CASE WHEN is_pdf AND page_count > 1 AND output_format <> 'pdf' THEN 'all_pages' ELSE pdf_image_mode END AS pdf_image_mode,
  CASE WHEN is_pdf AND page_count > 1 AND output_format <> 'pdf' THEN 0 ELSE pdf_page_index END AS pdf_page_index, 'specific' AS folder_rule FROM aj"""))
def watch_rules(spark, sf):
    return O.watch_rules(assets_jobs(spark, sf)).select(
        "asset_id", "job_id", "gif_mode", F.col("gif_frame_index").cast("bigint").alias("gif_frame_index"), "pdf_image_mode",
        F.col("pdf_page_index").cast("bigint").alias("pdf_page_index"), "folder_rule",
    )


@query(duck("jobs", """
SELECT job_id, model_stage AS uses_model, model_stage AS skips_unsupported, FALSE AS counts_known, output_format <> 'gif' AS expands_gif_frames,
  output_format <> 'pdf' AS expands_pdf_pages FROM jobs"""))
def watch_rule_summary(spark, sf):
    return O.watch_rule_summary(derive(spark, sf, "jobs")).select(
        "job_id", "uses_model", "skips_unsupported", "expands_gif_frames", "expands_pdf_pages",
        F.coalesce("total_inputs", "forced_background_inputs").isNotNull().alias("counts_known"),
    )


FORMATS = "['CODE_128','CODE_39','CODE_93','EAN_13','EAN_8','UPC_A','UPC_E','ITF','CODABAR','MSI','RSS_14','RSS_EXPANDED','AZTEC','DATA_MATRIX','PDF_417','QR_CODE']"
LINEAR = ["CODE_128", "CODE_39", "CODE_93", "EAN_13", "EAN_8", "UPC_A", "UPC_E", "ITF", "CODABAR", "MSI"]


@query(duck("jobs", f"""
, c AS (SELECT job_id, unnest(cf) AS c, unnest(range(1, len(cf) + 1)) AS o FROM (SELECT job_id, CASE job_id % 4 WHEN 0 THEN [' ean-13', 'QR code', 'EAN_13', 'nonsense'] WHEN 1 THEN ['???']
    WHEN 2 THEN ['itf', 'code 39'] ELSE CAST([] AS VARCHAR[]) END AS cf FROM jobs)),
k AS (SELECT job_id, replace(replace(upper(trim(c)), '-', '_'), ' ', '_') AS f, min(o) AS o FROM c GROUP BY 1, 2 HAVING list_contains({FORMATS}, f)),
r AS (SELECT job_id, f, o FROM k UNION ALL SELECT job_id, unnest({FORMATS}), unnest(range(1, 17)) FROM jobs WHERE job_id NOT IN (SELECT job_id FROM k))
SELECT job_id, coalesce(string_agg(f, ',' ORDER BY o) FILTER (list_contains({LINEAR!r}, f)), '') AS formats FROM r GROUP BY job_id"""))
def allowed_formats(spark, sf):
    lists = {0: [" ean-13", "QR code", "EAN_13", "nonsense"], 1: ["???"], 2: ["itf", "code 39"]}
    configured = F.when(F.lit(False), F.array(F.lit("")))
    for n, names in lists.items():
        configured = configured.when(F.col("job_id") % 4 == n, F.array(*[F.lit(x) for x in names]))
    return derive(spark, sf, "jobs").select(
        "job_id", F.array_join(formats_of(configured, LINEAR), ",").alias("formats")
    )


@query(duck("work runs", """
, s AS (SELECT run_id, count(*) FILTER (l_linestatus = 'F') AS n, count(*) FILTER (l_linestatus = 'F' AND failed) AS f, count(*) FILTER (l_linestatus = 'O') AS early FROM work GROUP BY 1)
SELECT r.run_id, coalesce(n + early, 0) AS total_count, coalesce(n + early, 0) AS processed_count, coalesce(n - f, 0) AS success_count, coalesce(f + early, 0) AS failure_count,
  CASE WHEN was_canceled THEN 'canceled' WHEN coalesce(f + early, 0) > 0 THEN 'completed_with_failures' ELSE 'completed' END AS status
FROM runs r LEFT JOIN s ON s.run_id = r.run_id"""), name="summarize_batch")
def summarize_batches(spark, sf):
    """Outcomes of the conversion stage and failures of the model stage, merged per run."""
    work = derive(spark, sf, "work")
    done, early = work.filter(F.col("l_linestatus") == "F"), work.filter(F.col("l_linestatus") == "O")
    return summarize_batch(done, derive(spark, sf, "runs"), early.select("run_id", "file_name")).select(
        "run_id", "total_count", "processed_count", "success_count", "failure_count", "status"
    )
