"""Row shapes and code sets shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Extensions accepted as input, output formats and their extensions.
SUPPORTED_INPUTS = [
    ".png", ".jpg", ".jpeg", ".webp", ".bmp", ".gif", ".tif", ".tiff", ".ico", ".svg", ".pdf", ".psd", ".exe", ".lnk",
]
OUTPUT_EXTENSIONS = {
    "png": ".png",
    "jpeg": ".jpg",
    "webp": ".webp",
    "bmp": ".bmp",
    "gif": ".gif",
    "tiff": ".tiff",
    "ico": ".ico",
    "svg": ".svg",
    "pdf": ".pdf",
}
OPAQUE_OUTPUTS = ["jpeg", "gif", "pdf"]
ENUMS = {
    "output_format": list(OUTPUT_EXTENSIONS),
    "compression_mode": ["custom", "high_quality", "balanced", "high_compression"],
    "resize_mode": ["none", "fixed_width", "fixed_height", "scale_percent", "custom_size"],
    "rename_mode": ["keep", "number", "prefix", "suffix"],
    "gif_mode": ["first", "all", "specific"],
    "folder_rule": ["source", "specific", "auto"],
    "pdf_image_mode": ["all_pages", "current_page"],
    "pdf_doc_mode": ["all_pages", "current_page", "page_range", "split"],
}

ASSET = T.StructType([
    T.StructField("asset_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("ext", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()),
    T.StructField("frame_count", T.LongType()),
    T.StructField("page_count", T.LongType()),
    T.StructField("is_pdf", T.BooleanType()),
    T.StructField("is_encrypted", T.BooleanType()),
    T.StructField("is_unlocked", T.BooleanType()),
    T.StructField("has_alpha", T.BooleanType()),
])

HISTORY = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("run_ts", T.TimestampNTZType()),
    T.StructField("trigger_source", T.StringType()),
    T.StructField("output_format", T.StringType()),
    T.StructField("original_bytes", T.LongType()),
    T.StructField("was_canceled", T.BooleanType()),
])

PRESET = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("output_format", T.StringType()),
    T.StructField("compression_mode", T.StringType()),
    T.StructField("quality", T.LongType()),
    T.StructField("resize_mode", T.StringType()),
    T.StructField("resize_width", T.LongType()),
    T.StructField("resize_height", T.LongType()),
    T.StructField("resize_percent", T.LongType()),
    T.StructField("rename_mode", T.StringType()),
    T.StructField("rename_prefix", T.StringType()),
    T.StructField("rename_suffix", T.StringType()),
    T.StructField("rename_start", T.LongType()),
    T.StructField("rename_digits", T.LongType()),
    T.StructField("folder_rule", T.StringType()),
    T.StructField("output_directory", T.StringType()),
    T.StructField("auto_folder", T.StringType()),
    T.StructField("allow_overwrite", T.BooleanType()),
    T.StructField("svg_use_background", T.BooleanType()),
    T.StructField("svg_background_color", T.StringType()),
    T.StructField("icon_use_transparency", T.BooleanType()),
    T.StructField("icon_background_color", T.StringType()),
    T.StructField("gif_mode", T.StringType()),
    T.StructField("gif_frame_index", T.LongType()),
    T.StructField("model_stage", T.BooleanType()),
    T.StructField("model_scale", T.LongType()),
    T.StructField("model_code", T.StringType()),
])

# What a preset field means when it is missing.
PRESET_DEFAULTS = {
    "name": "",
    "output_format": "png",
    "compression_mode": "custom",
    "quality": 100,
    "resize_mode": "none",
    "resize_width": 1280,
    "resize_height": 720,
    "resize_percent": 100,
    "rename_mode": "keep",
    "rename_prefix": "",
    "rename_suffix": "",
    "rename_start": 1,
    "rename_digits": 4,
    "folder_rule": "source",
    "output_directory": "",
    "auto_folder": "converted",
    "allow_overwrite": False,
    "svg_use_background": False,
    "svg_background_color": "#FFFFFFFF",
    "icon_use_transparency": True,
    "icon_background_color": "#FFFFFFFF",
    "gif_mode": "first",
    "gif_frame_index": 0,
    "model_stage": False,
    "model_scale": 2,
    "model_code": "standard",
}


def invalid_options(jobs):
    """Rows of ``jobs`` carrying a code outside its set (a validation predicate)."""
    from pyspark.sql import functions as F

    bad = None
    for column, codes in ENUMS.items():
        if column in jobs.columns:
            test = ~F.coalesce(F.col(column).isin(codes), F.lit(False))
            bad = test if bad is None else bad | test
    return jobs.filter(bad)
