"""Rules over one row of job options.  Column in, Column out; no UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.schemas import OPAQUE_OUTPUTS, OUTPUT_EXTENSIONS


def is_blank(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | (F.trim(c) == "")


def clamp(col: Column | str, low, high) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(c, low), high)


def normalize_options(jobs: DataFrame, auto_folder: str = "converted") -> DataFrame:
    """Every option forced into its legal range; blanks replaced by defaults."""
    white = F.lit("#FFFFFFFF")
    one = F.lit(1)
    return jobs.withColumns({
        "quality": clamp("quality", 1, 100),
        "resize_width": F.greatest("resize_width", one),
        "resize_height": F.greatest("resize_height", one),
        "resize_percent": clamp("resize_percent", 1, 1000),
        "rename_prefix": F.coalesce("rename_prefix", F.lit("")),
        "rename_suffix": F.coalesce("rename_suffix", F.lit("")),
        "rename_start": F.greatest("rename_start", F.lit(0)),
        "rename_digits": clamp("rename_digits", 1, 8),
        "output_directory": F.coalesce("output_directory", F.lit("")),
        "auto_folder": F.when(is_blank("auto_folder"), F.lit(auto_folder)).otherwise(F.trim("auto_folder")),
        "svg_background_color": F.when(is_blank("svg_background_color"), white).otherwise(F.col("svg_background_color")),
        "icon_background_color": F.when(is_blank("icon_background_color"), white).otherwise(F.col("icon_background_color")),
        "language_code": F.when(is_blank("language_code"), F.lit("en-US")).otherwise(F.col("language_code")),
        "gif_frame_index": F.greatest("gif_frame_index", F.lit(0)),
        "pdf_page_index": F.greatest("pdf_page_index", F.lit(0)),
    })


def resolve_quality(gif: bool = False) -> Column:
    mode = F.col("compression_mode")
    return (
        F.when(mode == "high_quality", 100 if gif else 92)
        .when(mode == "balanced", 80)
        .when(mode == "high_compression", 60)
        .otherwise(clamp("quality", 1, 100))
        .cast("bigint")
    )


def output_extension(fmt: Column | str = "output_format") -> Column:
    c = F.col(fmt) if isinstance(fmt, str) else fmt
    out = None
    for name, ext in OUTPUT_EXTENSIONS.items():
        out = F.when(c == name, ext) if out is None else out.when(c == name, ext)
    return out.otherwise(".png")


def supports_alpha(fmt: Column | str = "output_format") -> Column:
    c = F.col(fmt) if isinstance(fmt, str) else fmt
    return ~c.isin(OPAQUE_OUTPUTS)


def compression_risk() -> Column:
    mode = F.col("compression_mode")
    return F.col("output_format").isin("jpeg", "webp") & (
        (mode == "high_compression") | ((mode == "custom") & (F.col("quality") <= 45))
    )


def resolve_background(ext: Column | str = "ext") -> tuple[Column, Column]:
    """``(use_background, background_color)`` of a source under its job's options."""
    e = F.lower(F.col(ext)) if isinstance(ext, str) else F.lower(ext)
    opaque_out = ~supports_alpha()
    svg_use = F.col("svg_use_background") | opaque_out
    icon = e.isin(".exe", ".lnk")
    psd_opaque = (e == ".psd") & ~F.col("has_alpha")
    use = (
        F.when(icon, opaque_out | ~F.col("icon_use_transparency"))
        .when(psd_opaque, F.lit(False))
        .otherwise(svg_use)
    )
    colour = (
        F.when(icon, F.col("icon_background_color"))
        .when(e == ".svg", F.col("svg_background_color"))
        .when(psd_opaque, F.lit("#FFFFFFFF"))
        .when((e == ".psd") | svg_use, F.col("svg_background_color"))
        .otherwise(F.lit("#FFFFFFFF"))
    )
    return use, colour


def resolve_pdf_background(ext: Column | str = "ext") -> tuple[Column, Column]:
    """As :func:`resolve_background` for a PDF page: layered documents always sit on a colour."""
    e = F.lower(F.col(ext)) if isinstance(ext, str) else F.lower(ext)
    use, colour = resolve_background(ext)
    return (
        F.when(e == ".psd", F.lit(True)).otherwise(use),
        F.when((e == ".psd") & F.col("has_alpha"), F.col("svg_background_color")).otherwise(colour),
    )


def watch_rules(plan: DataFrame, profile_directory: str | None = None) -> DataFrame:
    """A watched file expands fully: all frames unless GIF out, all pages unless PDF
    out; the output folder is always the profile's own."""
    gif = (F.col("frame_count") > 1) & (F.col("output_format") != "gif")
    pdf = F.col("is_pdf") & (F.col("page_count") > 1) & (F.col("output_format") != "pdf")
    out = plan.withColumns({
        "gif_mode": F.when(gif, "all").otherwise(F.col("gif_mode")),
        "gif_frame_index": F.when(gif, 0).otherwise(F.col("gif_frame_index")),
        "pdf_image_mode": F.when(pdf, "all_pages").otherwise(F.col("pdf_image_mode")),
        "pdf_page_index": F.when(pdf, 0).otherwise(F.col("pdf_page_index")),
        "folder_rule": F.lit("specific"),
    })
    return out.withColumn("output_directory", F.col(profile_directory)) if profile_directory else out


def watch_rule_summary(profiles: DataFrame) -> DataFrame:
    """Profile-level rules; counts are null because no input is known yet."""
    unknown = F.lit(None).cast("bigint")
    return profiles.withColumns({
        "uses_model": F.col("model_stage"),
        "skips_unsupported": F.col("model_stage"),
        "total_inputs": unknown,
        "eligible_inputs": unknown,
        "expands_gif_frames": F.col("output_format") != "gif",
        "gif_expansion_inputs": unknown,
        "expands_pdf_pages": F.col("output_format") != "pdf",
        "pdf_expansion_inputs": unknown,
        "forced_background_inputs": unknown,
    })
