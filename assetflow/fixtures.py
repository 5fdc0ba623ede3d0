"""Typed inputs derived from the driver tables.

Each derivation is one SQL text that both Spark and DuckDB accept, so a query and
its oracle start from identical rows.  Only rasters differ, because the two engines
unnest arrays differently; Spark keeps them as one array per image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.session import table

ASSETS = """
SELECT asset_id, job_id, source, stem, ext, stem || ext AS file_name,
  '/in/' || source || '/' || stem || ext AS path,
  size_bytes, width, height,
  CASE WHEN ext = '.gif' THEN 1 + (asset_id % 9) * (CASE WHEN asset_id % 4 = 1 THEN 100 ELSE 1 END) ELSE 1 END AS frame_count,
  CASE WHEN ext = '.pdf' THEN 1 + size_bytes % 12 ELSE 0 END AS page_count,
  ext = '.pdf' AS is_pdf,
  ext = '.pdf' AND asset_id % 3 = 0 AS is_encrypted,
  NOT (ext = '.pdf' AND asset_id % 3 = 0) OR asset_id % 2 = 0 AS is_unlocked,
  CASE WHEN ext = '.svg' THEN TRUE WHEN ext IN ('.jpg','.jpeg','.bmp') THEN FALSE ELSE asset_id % 5 < 2 END AS has_alpha
FROM (SELECT doc_id AS asset_id, doc_id % 25 AS job_id, source,
  CASE WHEN doc_id % 11 = 0 THEN 'icon_' || CAST(doc_id % 97 AS STRING)
       WHEN doc_id % 13 = 0 THEN 'IMG_' || CAST(doc_id % 7 AS STRING) || '(1)'
       ELSE 'img_' || CAST(doc_id % 7 AS STRING) END AS stem,
  CASE doc_id % 17 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.webp' WHEN 4 THEN '.bmp'
    WHEN 5 THEN '.gif' WHEN 6 THEN '.tif' WHEN 7 THEN '.tiff' WHEN 8 THEN '.ico' WHEN 9 THEN '.svg' WHEN 10 THEN '.pdf'
    WHEN 11 THEN '.psd' WHEN 12 THEN '.exe' WHEN 13 THEN '.lnk' WHEN 14 THEN '.PNG' WHEN 15 THEN '.gif' ELSE '.txt' END AS ext,
  n_chars AS size_bytes, 16 + (n_chars * 7) % 3000 AS width, 16 + (n_chars * 13) % 2200 AS height
  FROM documents) d
"""

JOBS = """
SELECT CAST(n_nationkey AS BIGINT) AS job_id,
  CASE n_nationkey % 9 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' WHEN 3 THEN 'bmp' WHEN 4 THEN 'gif'
    WHEN 5 THEN 'tiff' WHEN 6 THEN 'ico' WHEN 7 THEN 'svg' ELSE 'pdf' END AS output_format,
  CASE n_nationkey % 4 WHEN 0 THEN 'custom' WHEN 1 THEN 'high_quality' WHEN 2 THEN 'balanced' ELSE 'high_compression' END AS compression_mode,
  CAST((n_nationkey * 37) % 130 AS BIGINT) AS quality,
  CASE n_nationkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'fixed_width' WHEN 2 THEN 'fixed_height' WHEN 3 THEN 'scale_percent' ELSE 'custom_size' END AS resize_mode,
  CAST(n_nationkey * 60 AS BIGINT) AS resize_width, CAST(n_nationkey * 45 AS BIGINT) AS resize_height, CAST(n_nationkey * 17 AS BIGINT) AS resize_percent,
  CASE n_nationkey % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'number' WHEN 2 THEN 'prefix' ELSE 'suffix' END AS rename_mode,
  'p:' || CAST(n_nationkey % 5 AS STRING) || '<_' AS rename_prefix,
  '_s?' || CAST(n_nationkey % 3 AS STRING) AS rename_suffix,
  CAST(n_nationkey - 3 AS BIGINT) AS rename_start, CAST(n_nationkey % 11 AS BIGINT) AS rename_digits,
  CASE n_nationkey % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'specific' ELSE 'auto' END AS folder_rule,
  CASE WHEN n_nationkey % 4 = 1 THEN '  ' ELSE '/out/j' || CAST(n_nationkey % 3 AS STRING) END AS output_directory,
  CASE WHEN n_nationkey % 5 = 2 THEN ' ' ELSE ' Done ' END AS auto_folder,
  n_nationkey % 5 = 0 AS allow_overwrite,
  n_nationkey % 6 = 0 AS svg_use_background,
  CASE WHEN n_nationkey % 4 = 2 THEN '' ELSE '#FF10203' || CAST(n_nationkey % 10 AS STRING) END AS svg_background_color,
  n_nationkey % 3 <> 0 AS icon_use_transparency,
  CASE WHEN n_nationkey % 5 = 3 THEN ' ' ELSE '#FF40506' || CAST(n_nationkey % 10 AS STRING) END AS icon_background_color,
  CASE WHEN n_nationkey % 7 = 0 THEN ' ' ELSE 'de-DE' END AS language_code,
  CASE n_nationkey % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'all' ELSE 'specific' END AS gif_mode,
  CAST(n_nationkey - 2 AS BIGINT) AS gif_frame_index,
  CASE n_nationkey % 2 WHEN 0 THEN 'all_pages' ELSE 'current_page' END AS pdf_image_mode,
  CASE n_nationkey % 4 WHEN 0 THEN 'all_pages' WHEN 1 THEN 'current_page' WHEN 2 THEN 'page_range' ELSE 'split' END AS pdf_doc_mode,
  CAST(n_nationkey - 4 AS BIGINT) AS pdf_page_index,
  n_nationkey % 2 = 0 AS model_stage, CAST(n_nationkey AS BIGINT) AS model_scale,
  CASE n_nationkey % 6 WHEN 0 THEN 'standard' WHEN 1 THEN 'general' WHEN 2 THEN 'anime' WHEN 3 THEN 'light' WHEN 4 THEN 'retired_a' ELSE 'unknown' END AS model_code
FROM nation
"""

OVERRIDES = f"""
SELECT asset_id, job_id, upper(path) AS path_key,
  CASE WHEN is_pdf THEN CASE WHEN asset_id % 2 = 0 THEN 'page' ELSE 'page_range' END
    ELSE CASE WHEN asset_id % 2 = 0 THEN 'frame' ELSE 'frame_range' END END AS kind,
  (asset_id % 15) - 3 AS start_index, (asset_id % 19) - 2 AS end_index, asset_id % 3 <> 0 AS flag
FROM ({ASSETS}) o
"""

WORK = """
SELECT l_orderkey AS run_id, l_linenumber AS item_no, l_partkey, 'Part_' || CAST(l_partkey AS STRING) || '.png' AS file_name,
  '/out/' || CAST(l_suppkey AS STRING) AS folder, l_returnflag = 'R' AS failed, l_shipdate AS finished_at,
  CAST(l_quantity AS BIGINT) AS work_items, l_suppkey, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem
"""

RUNS = """
SELECT o_orderkey AS run_id, o_orderdate AS run_ts, CASE WHEN o_orderstatus = 'F' THEN 'manual' ELSE 'watch' END AS trigger_source,
  lower(substr(o_orderpriority, 3)) AS output_format, CAST(floor(o_totalprice) AS BIGINT) AS original_bytes,
  o_orderkey % 10 = 0 AS was_canceled FROM orders
"""

FILE_EVENTS = """
SELECT event_id, ts, 'f' || CAST(user_id AS STRING) || CASE event_type WHEN 'view' THEN '.png' WHEN 'click' THEN '.GIF' WHEN 'error' THEN '.tmp' ELSE '.pdf' END AS path,
  CAST(floor(value / 100) AS BIGINT) AS length FROM events
"""

FRAMES = """
SELECT user_id AS asset_id, event_id AS frame_no, CAST(floor(value / 10) AS BIGINT) - 3 AS delay_cs,
  CAST(floor(value) AS BIGINT) - 20 AS duration_ms FROM events
"""

DETECTIONS = """
SELECT l_orderkey AS image_id, l_linenumber AS seq, l_partkey AS tie, 'C' || l_returnflag || l_linestatus AS content,
  CASE l_linenumber % 3 WHEN 0 THEN 'QR' WHEN 1 THEN 'EAN-13' ELSE 'Code128' END AS format,
  l_discount * 10 AS cx, l_tax * 12.5 AS cy, l_suppkey AS tie2, l_extendedprice AS tie3 FROM lineitem
"""

LAYERS = """
SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_partkey AS tie, CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE 'layer ' || CAST(l_partkey AS STRING) END AS name,
  CAST(l_quantity AS BIGINT) AS width, l_suppkey AS height, l_partkey % 4 = 0 AS is_hidden, l_partkey % 7 = 0 AS is_group_start, l_partkey % 7 = 1 AS is_group_end,
  l_partkey % 5 = 0 AS is_text, l_partkey % 6 = 0 AS is_shape, l_partkey % 8 = 0 AS is_smart, l_partkey % 11 = 0 AS has_vector_path,
  l_partkey % 10 = 0 AS is_locked, l_partkey % 5 AS compression_code, l_suppkey AS tie2, l_extendedprice AS tie3 FROM lineitem
"""

TEXTS = """
SELECT doc_id AS text_id, text || CASE doc_id % 8 WHEN 1 THEN ' 한글 문서' WHEN 2 THEN ' Привет мир' WHEN 3 THEN ' ไทย' WHEN 4 THEN ' مرحبا'
  WHEN 5 THEN ' 漢字かな國国' WHEN 6 THEN ' Ünïcödé' ELSE '' END AS text, CAST(doc_id % 101 AS DOUBLE) / 100 AS confidence FROM documents
"""

URL_TEXTS = """
SELECT page_id, 'see ' || url || '). Also ' || replace(url, 'http', 'HTTP') || ', then ' || url || '/x!' AS text, url FROM pages
"""

LOCALES = """
SELECT role AS locale, 'k' || CAST(conv_id AS STRING) || '_' || CAST(turn - turn % 2 AS STRING) AS key, text AS value FROM conversations
"""

PROFILES = """
SELECT CAST(n_nationkey AS BIGINT) AS profile_id,
  CASE WHEN n_nationkey % 8 = 5 THEN ' ' ELSE '/watch/' || lower(n_name) END AS input_directory,
  CASE n_nationkey % 6 WHEN 0 THEN '' WHEN 1 THEN '/watch/' || upper(n_name) || '/out' WHEN 2 THEN '/watch' WHEN 3 THEN '/watch/' || lower(n_name)
    ELSE '/watch/' || lower(n_name) || '_out' END AS output_directory
FROM nation
"""

PDF_TEXTS = """
SELECT asset_id, is_encrypted,
  CASE WHEN asset_id % 4 = 3 THEN '' ELSE '%PDF-1.' || CAST(asset_id % 8 AS STRING) END || ' obj '
  || CASE WHEN asset_id % 5 = 0 THEN '/Author (Ann ' || CAST(asset_id AS STRING) || ') ' WHEN asset_id % 5 = 1 THEN '/Author () ' ELSE '' END
  || CASE WHEN asset_id % 3 = 0 THEN '/Encrypt << /V 2 /P -' || CAST(asset_id * 7 AS STRING) || ' >> ' ELSE '' END
  || CASE WHEN asset_id % 2 = 0 THEN '/Producer (info ' || CAST(asset_id AS STRING) || ') ' ELSE '' END
  || CASE WHEN asset_id % 6 = 1 THEN '<rdf pdf:Producer = ''xmp ' || CAST(asset_id AS STRING) || '''/> ' ELSE '' END
  || CASE WHEN asset_id % 7 = 2 THEN '<dc:title><rdf:Alt><rdf:li xml:lang="x">T' || CAST(asset_id AS STRING) || '</rdf:li></rdf:Alt></dc:title>' ELSE '/Title (  ) ' END
  || CASE WHEN asset_id % 9 = 4 THEN '<dc:creator><rdf:Seq><rdf:li>C' || CAST(asset_id AS STRING) || '</rdf:li></rdf:Seq></dc:creator>' ELSE '' END
  || text AS sample
FROM (SELECT doc_id AS asset_id, doc_id % 3 = 0 AS is_encrypted, text FROM documents) d
"""

EXIF = """
SELECT l_orderkey AS asset_id, l_linenumber AS item_no, l_partkey, CAST(l_quantity AS BIGINT) AS ap_num, l_suppkey % 11 AS ap_den,
  CAST(l_linenumber AS BIGINT) AS ex_num, l_partkey % 500 AS ex_den, l_partkey % 40 - 3 AS iso,
  CASE l_linenumber % 3 WHEN 0 THEN '2024:01:0' || CAST(1 + l_partkey % 9 AS STRING) || ' 10:20:30' WHEN 1 THEN 'yesterday' ELSE ' ' END AS taken,
  l_suppkey, l_extendedprice FROM lineitem
"""

PRESETS = """
SELECT CAST(n_nationkey AS BIGINT) AS saved_at,
  '{"name":" ' || CASE WHEN n_nationkey % 2 = 0 THEN 'Web ' ELSE 'WEB ' END || CAST(n_nationkey % 6 AS STRING) || ' "'
  || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE ',"quality":' || CAST(n_nationkey * 9 AS STRING) END
  || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE ',"output_format":"webp"' END
  || CASE n_nationkey % 4 WHEN 0 THEN ',"model_code":"retired_a"' WHEN 1 THEN ',"model_code":"anime"' WHEN 2 THEN ',"model_code":"retired_b"' ELSE '' END
  || CASE WHEN n_nationkey % 5 = 0 THEN ',"allow_overwrite":true' ELSE '' END
  || '}' AS body
FROM nation
"""

TEXT_OF = {
    "assets": (ASSETS, "documents"),
    "jobs": (JOBS, "nation"),
    "overrides": (OVERRIDES, "documents"),
    "work": (WORK, "lineitem"),
    "runs": (RUNS, "orders"),
    "file_events": (FILE_EVENTS, "events"),
    "frames": (FRAMES, "events"),
    "detections": (DETECTIONS, "lineitem"),
    "layers": (LAYERS, "lineitem"),
    "texts": (TEXTS, "documents"),
    "url_texts": (URL_TEXTS, "pages"),
    "locales": (LOCALES, "conversations"),
    "profiles": (PROFILES, "nation"),
    "pdf_texts": (PDF_TEXTS, "documents"),
    "exif": (EXIF, "lineitem"),
    "presets": (PRESETS, "nation"),
}

# One row per pixel of every 8x8 raster, for DuckDB only.
PIXELS_DUCK = """
SELECT image_id, x, y, v, r, (r * 7) % 256 AS g, (r * 13) % 256 AS b, CASE WHEN r % 5 = 0 THEN 0 ELSE 255 END AS a
FROM (SELECT vec_id AS image_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, CAST(embedding[i] AS DOUBLE) AS v,
        CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 127) AS BIGINT) AS r
      FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)) p
"""

RECOGNITIONS_DUCK = """
SELECT vec_id AS image_id, CASE WHEN vec_id % 4 <> 0 THEN [CAST(s AS DOUBLE) * 2 FOR s IN embedding] ELSE [] END AS scores,
  label / 10.0::DOUBLE AS box_score FROM embeddings
"""


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table ``name`` as a DataFrame; nothing is materialised."""
    text, base = TEXT_OF[name]
    head, tail = text.rsplit(f"FROM {base}", 1)
    head, tail = (part.replace("{", "{{").replace("}", "}}") for part in (head, tail))
    return spark.sql(head + "FROM {src}" + tail, src=table(spark, sf_dir, base))


def assets_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets with the options of their job.  No broadcast hint: Spark picks the
    join from the size of ``jobs`` and splits a hot job at run time."""
    return derive(spark, sf_dir, "assets").join(derive(spark, sf_dir, "jobs"), "job_id")


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, width, height, px`` with ``px`` row-major ``array<struct<r,g,b,a>>``."""

    def pixel(v):
        r = F.floor((v.cast("double") + 1) * 127)
        return F.struct(
            r.alias("r"),
            ((r * 7) % 256).alias("g"),
            ((r * 13) % 256).alias("b"),
            F.when(r % 5 == 0, F.lit(0)).otherwise(255).cast("bigint").alias("a"),
        )

    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.lit(8).cast("bigint").alias("width"),
        F.lit(8).cast("bigint").alias("height"),
        F.transform("embedding", pixel).alias("px"),
    )


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, v`` with ``v`` the raw values as doubles."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("v")
    )


def recognitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.when(F.col("vec_id") % 4 != 0, F.transform("embedding", lambda s: s.cast("double") * 2))
        .otherwise(F.array().cast("array<double>"))
        .alias("scores"),
        (F.col("label") / F.lit(10.0)).alias("box_score"),
    )


def duck(names: str, body: str) -> str:
    """An oracle text: the named derivations as CTEs in front of ``body``."""
    parts = []
    for name in names.split():
        if name == "pixels":
            sql = PIXELS_DUCK
        elif name == "recognitions":
            sql = RECOGNITIONS_DUCK
        elif name == "aj":
            sql = "SELECT a.*, j.* EXCLUDE (job_id) FROM assets a JOIN jobs j ON a.job_id = j.job_id"
        else:
            sql = TEXT_OF[name][0]
        parts.append(f"{name} AS ({sql.strip()})")
    text = "WITH " + ",\n".join(parts) + "\n" + body.strip()
    return text.replace("count_if(", "count(*) FILTER (WHERE ")  # a BIGINT, as Spark counts
