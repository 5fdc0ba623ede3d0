"""Asset identity, content and metadata rules (B, part of I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetflow.fixtures import assets_jobs, derive, duck
from assetflow.functions import content as C
from assetflow.functions import display as D
from assetflow.functions import geometry as G
from assetflow.operators.lookups import lock_skips as with_locks
from assetflow.plans import details
from assetflow.queries.base import query, rounded

KIND_SQL = """CASE WHEN e = '.svg' THEN 'vector' WHEN e IN ('.exe', '.lnk') THEN 'icon'
  WHEN e = '.ico' OR regexp_matches(lower(file_name), 'icon|logo|favicon|appicon|avatar')
    OR (width <= 512 AND height <= 512 AND abs(width - height) <= greatest(width, height) * 0.18::DOUBLE AND has_alpha) THEN 'icon'
  WHEN has_alpha THEN 'transparent_graphic'
  WHEN width * height >= 500000 AND width >= 800 AND height >= 500 THEN 'photo' ELSE 'unknown' END"""


@query(duck("assets", """
SELECT asset_id, file_name, upper(ext[2:]) AS ext_upper, size_bytes, frame_count > 1 AS is_animated, is_pdf OR page_count > 0 AS is_pdf,
  width * height AS pixel_count, width || ' x ' || height AS resolution_text, is_encrypted, is_unlocked FROM assets"""))
def derive_identity(spark, sf):
    return C.derive_identity(derive(spark, sf, "assets")).select(
        "asset_id", "file_name", "ext_upper", "size_bytes", "is_animated", "is_pdf", "pixel_count", "resolution_text",
        "is_encrypted", "is_unlocked",
    )


@query(duck("assets", f"SELECT asset_id, {KIND_SQL} AS kind FROM (SELECT *, lower(ext) AS e FROM assets)"))
def classify_content(spark, sf):
    return derive(spark, sf, "assets").select("asset_id", C.content_kind().alias("kind"))


@query(duck("assets", f"""
SELECT asset_id, kind, p AS primary_format, s AS secondary_format, upper(p) || ' / ' || upper(s) AS formats_text FROM (
  SELECT asset_id, kind, CASE kind WHEN 'photo' THEN 'webp' WHEN 'transparent_graphic' THEN 'png' WHEN 'icon' THEN 'png' WHEN 'vector' THEN 'svg' ELSE 'webp' END AS p,
    CASE kind WHEN 'photo' THEN 'jpeg' WHEN 'transparent_graphic' THEN 'webp' WHEN 'icon' THEN 'ico' WHEN 'vector' THEN 'png' ELSE 'png' END AS s
  FROM (SELECT asset_id, {KIND_SQL} AS kind FROM (SELECT *, lower(ext) AS e FROM assets)))"""))
def recommend_formats(spark, sf):
    kinds = derive(spark, sf, "assets").select("asset_id", C.content_kind().alias("kind"))
    primary, secondary = C.recommend("kind")
    return kinds.select(
        "asset_id", "kind", primary.alias("primary_format"), secondary.alias("secondary_format"),
        C.recommendation_text(primary, secondary).alias("formats_text"),
    )


@query(duck("assets", """
SELECT asset_id, is_eligible, is_eligible AND lower(ext) IN ('.jpg','.jpeg','.png','.webp') AS is_engine_ready FROM (
  SELECT asset_id, ext, NOT is_pdf AND frame_count <= 1 AND lower(ext) IN ('.jpg','.jpeg','.png','.webp','.bmp','.tif','.tiff','.gif') AS is_eligible FROM assets)"""))
def model_eligible(spark, sf):
    return derive(spark, sf, "assets").select(
        "asset_id", C.model_eligible().alias("is_eligible"), C.engine_ready().alias("is_engine_ready")
    )


@query(duck("assets overrides", """
SELECT a.asset_id, l.locked, CASE WHEN l.locked THEN 'locked' END AS skip_reason FROM assets a JOIN (
  SELECT b.asset_id, b.is_pdf AND ((b.is_encrypted AND NOT b.is_unlocked) OR NOT coalesce(o.unlocked, TRUE)) AS locked
  FROM assets b LEFT JOIN (SELECT lower(path_key) AS k, bool_and(flag) AS unlocked FROM overrides GROUP BY 1) o ON lower(b.path) = o.k) l
ON a.asset_id = l.asset_id"""))
def lock_skip(spark, sf):
    unlocks = derive(spark, sf, "overrides").select("path_key", F.col("flag").alias("unlocked"))
    return with_locks(derive(spark, sf, "assets"), unlocks).select("asset_id", "locked", "skip_reason")


@query(duck("assets", """
SELECT asset_id, CASE
  WHEN (abs(w - 148) <= 6 AND abs(h - 210) <= 6) OR (abs(w - 210) <= 6 AND abs(h - 148) <= 6) THEN 'A5'
  WHEN (abs(w - 210) <= 6 AND abs(h - 297) <= 6) OR (abs(w - 297) <= 6 AND abs(h - 210) <= 6) THEN 'A4'
  WHEN (abs(w - 297) <= 6 AND abs(h - 420) <= 6) OR (abs(w - 420) <= 6 AND abs(h - 297) <= 6) THEN 'A3'
  WHEN (abs(w - 215.9) <= 6 AND abs(h - 279.4) <= 6) OR (abs(w - 279.4) <= 6 AND abs(h - 215.9) <= 6) THEN 'Letter'
  WHEN (abs(w - 215.9) <= 6 AND abs(h - 355.6) <= 6) OR (abs(w - 355.6) <= 6 AND abs(h - 215.9) <= 6) THEN 'Legal' END AS page_class,
  CAST(round(w, 3) AS DOUBLE) AS width_mm
FROM (SELECT asset_id, CAST(400 + width % 500 AS DOUBLE) * 25.4::DOUBLE / 72.0::DOUBLE AS w, CAST(580 + height % 430 AS DOUBLE) * 25.4::DOUBLE / 72.0::DOUBLE AS h FROM assets)"""))
def page_size_class(spark, sf):
    sized = derive(spark, sf, "assets").select(
        "asset_id", (400 + F.col("width") % 500).cast("double").alias("w"), (580 + F.col("height") % 430).cast("double").alias("h")
    )
    return sized.select(
        "asset_id", G.page_size_class("w", "h").alias("page_class"), F.round(G.points_to_mm(F.col("w")), 3).alias("width_mm")
    )


@query(duck("assets", """
SELECT asset_id, CASE WHEN e IN ('.jpg','.jpeg') THEN 'JPEG (lossy)' WHEN e = '.png' THEN 'PNG (lossless)' WHEN e = '.webp' AND frame_count > 1 THEN 'WEBP (animated)'
   WHEN e = '.webp' THEN 'WEBP' WHEN e = '.bmp' THEN 'BMP' WHEN e = '.gif' AND frame_count > 1 THEN 'GIF (animated)' WHEN e = '.gif' THEN 'GIF'
   WHEN e IN ('.tif','.tiff') THEN 'TIFF' WHEN e = '.ico' THEN 'ICO' WHEN e = '.svg' THEN 'SVG (vector)' WHEN e = '.psd' THEN 'PSD' ELSE upper(ext[2:]) END AS compression,
  CASE WHEN t IN ('gray8', 'alpha8') THEN 'Grayscale' WHEN t IN ('rgb565', 'rgb888x') THEN 'RGB' WHEN has_alpha THEN 'RGBA' ELSE 'RGB' END AS color_mode,
  CASE t WHEN 'gray8' THEN 8 WHEN 'rgb565' THEN 16 WHEN 'rgbaf16' THEN 64 WHEN 'bgra8888' THEN 32 ELSE -1 END::BIGINT AS bit_depth
FROM (SELECT *, lower(ext) AS e, CASE width % 5 WHEN 0 THEN 'gray8' WHEN 1 THEN 'rgb565' WHEN 2 THEN 'bgra8888' WHEN 3 THEN 'rgbaf16' ELSE 'other' END AS t FROM assets)"""))
def codec_labels(spark, sf):
    n = F.col("width") % 5
    t = F.when(n == 0, "gray8").when(n == 1, "rgb565").when(n == 2, "bgra8888").when(n == 3, "rgbaf16").otherwise("other")
    return derive(spark, sf, "assets").withColumn("t", t).select(
        "asset_id", C.compression_label().alias("compression"), C.color_mode("t").alias("color_mode"), F.coalesce(C.bit_depth("t"), F.lit(-1)).alias("bit_depth")
    )


SIZE_SQL = "CASE WHEN {0} < 1024 THEN {0} || ' B' WHEN {0} < 1048576 THEN printf('%.1f', round({0} / 1024.0::DOUBLE, 1)) || ' KB' ELSE printf('%.1f', round({0} / 1048576.0::DOUBLE, 1)) || ' MB' END"
DURATION_SQL = """CASE WHEN ms >= 3600000 THEN (ms // 3600000) || printf(':%02d:%02d', ms // 60000 % 60, ms // 1000 % 60)
  ELSE printf('%02d:%02d.%02d', ms // 60000 % 60, ms // 1000 % 60, ms % 1000 // 10) END"""


@query(duck("runs", f"""
SELECT run_id, {SIZE_SQL.format('b')} AS size_text, {SIZE_SQL.format('lo')} || ' - ' || {SIZE_SQL.format('b')} AS range_text, {DURATION_SQL} AS duration_text
FROM (SELECT run_id, original_bytes * 11 AS b, original_bytes // 300 AS lo, original_bytes * 37 % 9000000 AS ms FROM runs)"""), name="format_bytes")
def format_texts(spark, sf):
    runs = derive(spark, sf, "runs").select(
        "run_id", (F.col("original_bytes") * 11).alias("b"), F.expr("original_bytes div 300").alias("lo"),
        (F.col("original_bytes") * 37 % 9000000).alias("ms"),
    )
    return runs.select(
        "run_id", D.format_bytes("b").alias("size_text"), D.format_bytes_range("lo", "b").alias("range_text"),
        D.format_duration("ms").alias("duration_text"),
    )


@query(duck("exif", r"""
SELECT asset_id, item_no, l_partkey,
  CASE WHEN ap > 0 THEN 'f/' || regexp_replace(printf('%.2f', round(ap, 2)), '0$', '') END AS aperture,
  CASE WHEN sh > 0 AND sh < 1 AND round_even(1 / sh, 0) >= 1 THEN '1/' || CAST(round_even(1 / sh, 0) AS BIGINT) || ' s'
       WHEN sh > 0 THEN regexp_replace(regexp_replace(printf('%.3f', round(sh, 3)), '0{1,3}$', ''), '\.$', '') || ' s' END AS shutter,
  CASE WHEN iso > 0 THEN CAST(iso AS VARCHAR) END AS iso,
  CASE WHEN trim(taken) = '' THEN NULL WHEN taken LIKE '2024%' THEN replace(taken[1:10], ':', '-') || taken[11:] ELSE taken END AS taken
FROM (SELECT *, CASE WHEN ap_den <> 0 THEN CAST(ap_num AS DOUBLE) / ap_den END AS ap, CASE WHEN ex_den <> 0 THEN CAST(ex_num AS DOUBLE) / ex_den END AS sh FROM exif)"""))
def exif_display(spark, sf):
    ap = D.rational(F.col("ap_num"), F.col("ap_den"))
    sh = D.rational(F.col("ex_num"), F.col("ex_den"))
    return derive(spark, sf, "exif").select(
        "asset_id", "item_no", "l_partkey", D.aperture_text(ap).alias("aperture"), D.shutter_text(sh).alias("shutter"),
        D.iso_text(F.col("iso")).alias("iso"), D.taken_text(F.col("taken")).alias("taken"),
    )


PACKET_FIRST = "coalesce(nullif(trim({x}), ''), nullif(trim({i}), ''), CASE WHEN {m} THEN 'Unknown' END)"


@query(duck("pdf_texts", r"""
, v AS (SELECT asset_id, is_encrypted, instr(sample, '%PDF-') AS va, instr(sample, '/Encrypt') AS ea, sample,
    regexp_extract(sample, '(?i)pdf:Producer\s*=\s*["'']([^"'']*)["'']', 1) AS px, regexp_extract(sample, '/Producer\s*\(([^()\\]*)\)', 1) AS pi,
    regexp_extract(sample, '(?is)<dc:title[^>]*>.*?<rdf:li[^>]*>([^<]*)<', 1) AS tx, regexp_extract(sample, '/Title\s*\(([^()\\]*)\)', 1) AS ti,
    regexp_matches(sample, '/Title\s*\(([^()\\]*)\)') OR regexp_matches(sample, '(?i)<dc:title[\s>]') AS tm,
    regexp_extract(sample, '(?is)<dc:creator[^>]*>.*?<rdf:li[^>]*>([^<]*)<', 1) AS ax, regexp_extract(sample, '/Author\s*\(([^()\\]*)\)', 1) AS ai,
    regexp_matches(sample, '/Author\s*\(([^()\\]*)\)') OR regexp_matches(sample, '(?i)<dc:creator[\s>]') AS am
  FROM pdf_texts),
f AS (SELECT *, CASE WHEN is_encrypted AND ea > 0 THEN TRY_CAST(regexp_extract(substr(sample, ea), '/P\s+(-?\d+)', 1) AS BIGINT) END AS flags FROM v)
SELECT asset_id, CASE WHEN va > 0 THEN nullif(trim(substr(sample, va + 5, 3)), '') END AS version, ea > 0 AS has_encryption_marker,
  coalesce(CAST(CASE WHEN NOT is_encrypted THEN TRUE ELSE (flags & 16) <> 0 END AS VARCHAR), 'unknown') AS allow_copy,
  coalesce(CAST(CASE WHEN NOT is_encrypted THEN TRUE ELSE (flags & 4) <> 0 END AS VARCHAR), 'unknown') AS allow_print,
  coalesce(nullif(trim(ai), ''), nullif(trim(ax), ''), CASE WHEN am THEN 'Unknown' END) AS author,
  coalesce(nullif(trim(px), ''), nullif(trim(pi), '')) AS producer,
  coalesce(nullif(trim(tx), ''), nullif(trim(ti), ''), CASE WHEN tm THEN 'Unknown' END) AS title
FROM f"""))
def pdf_text_metadata(spark, sf):
    s = F.col("sample")
    copy, printing = D.document_permissions(s, F.col("is_encrypted"))
    return derive(spark, sf, "pdf_texts").select(
        "asset_id", D.document_version(s).alias("version"), F.contains(s, F.lit("/Encrypt")).alias("has_encryption_marker"),
        F.coalesce(copy.cast("string"), F.lit("unknown")).alias("allow_copy"),
        F.coalesce(printing.cast("string"), F.lit("unknown")).alias("allow_print"),
        D.document_field(s, "Author", packet_first=False).alias("author"),
        D.document_field(s, "Producer", packet_first=True).alias("producer"),
        D.document_field(s, "Title", packet_first=True).alias("title"),
    )


@query(duck("assets", """
SELECT asset_id, side AS icon_side, iw AS icon_width, ih AS icon_height, (side - iw) / 2.0::DOUBLE AS icon_x, (side - ih) / 2.0::DOUBLE AS icon_y,
  bw AS fit_width, bh AS fit_height, (320 - bw) // 2 AS fit_x, (320 - bh) // 2 AS fit_y,
  CASE WHEN m <= 1024 THEN width ELSE greatest(1, CAST(round(width * (1024.0::DOUBLE / m)) AS BIGINT)) END AS max_width,
  CASE WHEN m <= 1024 THEN height ELSE greatest(1, CAST(round(height * (1024.0::DOUBLE / m)) AS BIGINT)) END AS max_height,
  least(width, 3600) AS decode_width, round(least(greatest(800.0::DOUBLE / width, 0.4), 4.0), 6) AS preview_scale,
  round(least(greatest(CAST(greatest(2000, width * 2) AS DOUBLE) / width, 1.0), 6.0), 6) AS export_scale,
  CAST(greatest(1.0, 1600.0::DOUBLE / m) > 1.05 AS BOOLEAN) AS upscale_worth,
  CASE WHEN greatest(1.0, 1600.0::DOUBLE / m) > 1.05 THEN CAST(round_even(width * (1600.0::DOUBLE / m), 0) AS BIGINT) ELSE -1 END AS upscale_width,
  CASE WHEN greatest(1.0, 1600.0::DOUBLE / m) > 1.05 THEN CAST(round_even(height * (1600.0::DOUBLE / m), 0) AS BIGINT) ELSE -1 END AS upscale_height
FROM (SELECT *, greatest(1, CAST(round_even(width * CAST(sc AS DOUBLE), 0) AS BIGINT)) AS iw, greatest(1, CAST(round_even(height * CAST(sc AS DOUBLE), 0) AS BIGINT)) AS ih,
    greatest(1, CAST(round(width * fs) AS BIGINT)) AS bw, greatest(1, CAST(round(height * fs) AS BIGINT)) AS bh
  FROM (SELECT *, least(CAST(CAST(side AS DOUBLE) / width AS FLOAT), CAST(CAST(side AS DOUBLE) / height AS FLOAT)) AS sc, least(320.0::DOUBLE / width, 320.0::DOUBLE / height) AS fs
    FROM (SELECT asset_id, width, height, greatest(width, height) AS m, least(256, greatest(width, height)) AS side FROM assets)))"""))
def fit_geometry(spark, sf):
    w, h = F.col("width"), F.col("height")
    cells = G.icon_box(w, h) | G.letterbox(w, h, 320, 320) | G.downscale(w, h, 1024)
    cells["decode_width"] = G.decode_width(w, 1200, 1.0)
    cells["preview_scale"] = rounded(G.preview_scale(w, 800))
    cells["export_scale"] = rounded(G.export_scale(w, 2000))
    cells |= {n: c if n == "upscale_worth" else F.coalesce(c, F.lit(-1)) for n, c in G.upscale_plan(w, h, 1600).items()}
    return derive(spark, sf, "assets").select("asset_id", *[c.alias(n) for n, c in cells.items()])


GROUPED_SQL = "regexp_replace(reverse(regexp_replace(reverse(CAST({0} AS VARCHAR)), '(\\d{{3}})', '\\1,', 'g')), '^,', '')"

ENTRIES_SQL = f"""
, entries AS (SELECT asset_id, unnest([
  {{'section': 'General', 'ord': 0, 'label': 'Name', 'value': file_name}}, {{'section': 'General', 'ord': 1, 'label': 'Path', 'value': path}},
  {{'section': 'General', 'ord': 2, 'label': 'File type', 'value': '.' || upper(ext[2:])}},
  {{'section': 'General', 'ord': 3, 'label': 'Size', 'value': {SIZE_SQL.format('size_bytes')} || ' (' || {GROUPED_SQL.format('size_bytes')} || ' B)'}},
  {{'section': 'Image', 'ord': 4, 'label': 'Resolution', 'value': CASE WHEN NOT is_pdf THEN width || ' x ' || height END}},
  {{'section': 'Image', 'ord': 5, 'label': 'Pixel count', 'value': CASE WHEN NOT is_pdf THEN {GROUPED_SQL.format('(width * height)')} END}},
  {{'section': 'Image', 'ord': 6, 'label': 'Color mode', 'value': CASE WHEN NOT is_pdf THEN CASE WHEN has_alpha THEN 'RGBA' ELSE 'RGB' END END}},
  {{'section': 'Image', 'ord': 7, 'label': 'Transparency', 'value': CASE WHEN NOT is_pdf THEN CASE WHEN has_alpha THEN 'Yes' ELSE 'No' END END}},
  {{'section': 'Image', 'ord': 8, 'label': 'Compression', 'value': CASE WHEN NOT is_pdf THEN CASE WHEN e IN ('.jpg','.jpeg') THEN 'JPEG (lossy)' WHEN e = '.png' THEN 'PNG (lossless)'
   WHEN e = '.webp' THEN 'WEBP' WHEN e = '.bmp' THEN 'BMP' WHEN e = '.gif' AND frame_count > 1 THEN 'GIF (animated)' WHEN e = '.gif' THEN 'GIF'
   WHEN e IN ('.tif','.tiff') THEN 'TIFF' WHEN e = '.ico' THEN 'ICO' WHEN e = '.svg' THEN 'SVG (vector)' WHEN e = '.psd' THEN 'PSD' ELSE upper(ext[2:]) END END}},
  {{'section': 'Image', 'ord': 9, 'label': 'Animation frames', 'value': CASE WHEN NOT is_pdf AND frame_count > 1 THEN CAST(frame_count AS VARCHAR) END}},
  {{'section': 'Document', 'ord': 10, 'label': 'Page count', 'value': CASE WHEN is_pdf THEN CAST(page_count AS VARCHAR) END}},
  {{'section': 'Document', 'ord': 11, 'label': 'Encrypted', 'value': CASE WHEN is_pdf THEN CASE WHEN is_encrypted THEN 'Yes' ELSE 'No' END END}},
  {{'section': 'Document', 'ord': 12, 'label': 'Copy allowed', 'value': CASE WHEN is_pdf AND NOT is_encrypted THEN 'Yes' END}}
  ], recursive := true) FROM (SELECT *, lower(ext) AS e FROM assets))
"""


@query(duck("assets", ENTRIES_SQL + "SELECT asset_id, section, CAST(ord AS BIGINT) AS ord, label, value FROM entries"))
def detail_rows(spark, sf):
    return details.detail_rows(derive(spark, sf, "assets"))


@query(duck("assets", ENTRIES_SQL + r"""
SELECT asset_id, string_agg(CASE WHEN ord IN (0, 4, 10) THEN '[' || section || ']' || chr(10) ELSE '' END || label || ': ' || coalesce(value, 'Unknown'), chr(10) ORDER BY ord) AS text
FROM entries GROUP BY asset_id"""))
def detail_text(spark, sf):
    return details.detail_text(details.detail_rows(derive(spark, sf, "assets")))


@query(duck("assets jobs aj", """
SELECT asset_id, job_id, CAST(sc AS BIGINT) AS scale, CAST(4 AS BIGINT) AS inference_scale, sc > 4 AS needs_second_pass,
  CAST(CASE WHEN sc > 4 THEN 16 ELSE 4 END AS BIGINT) AS raw_scale, width * sc AS final_width, height * sc AS final_height,
  CAST(greatest(1, round(width * (CAST(sc AS DOUBLE) / CASE WHEN sc > 4 THEN 16 ELSE 4 END))) AS BIGINT) AS unsized_width
FROM (SELECT *, least(greatest(model_scale, 2), 16) AS sc FROM aj)"""))
def model_scale_plan(spark, sf):
    plan = assets_jobs(spark, sf)
    cells = G.scale_plan()
    unsized = G.final_dimension(F.lit(0).cast("bigint"), F.col("width"), cells["scale"], cells["raw_scale"])
    return plan.select("asset_id", "job_id", *[c.alias(n) for n, c in cells.items()], unsized.alias("unsized_width"))
