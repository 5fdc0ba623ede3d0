"""Asset identity, content class, transparency and codec labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extension_of(path: Column | str) -> Column:
    """``.ext`` of the last path segment, or an empty string."""
    return F.regexp_extract(path, r"(\.[^./\\]*)$", 1)


def directory_of(path: Column | str) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def name_of(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem_of(path: Column | str) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name_of(path), r"\.[^.]*$", "")


def derive_identity(assets: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    is_pdf = F.col("is_pdf") | (F.col("page_count") > 0)
    encrypted = is_pdf & F.col("is_encrypted")
    base = assets.withColumns({
        "file_name": name_of("path"),
        "ext_upper": F.upper(F.ltrim(extension_of("path"), F.lit("."))),
        "size_bytes": F.greatest("size_bytes", zero),
        "width": F.greatest("width", zero),
        "height": F.greatest("height", zero),
        "frame_count": F.greatest("frame_count", F.lit(1).cast("bigint")),
        "page_count": F.greatest("page_count", zero),
        "is_unlocked": ~is_pdf | ~encrypted | F.col("is_unlocked"),
        "is_encrypted": encrypted,
        "is_pdf": is_pdf,
    })
    return base.withColumns({
        "is_animated": F.col("frame_count") > 1,
        "pixel_count": F.col("width") * F.col("height"),
        "resolution_text": F.when(
            (F.col("width") > 0) & (F.col("height") > 0), F.concat_ws(" x ", "width", "height")
        ).otherwise("-"),
    })


# Words in a file name that mark an icon.
ICON_WORDS = "icon|logo|favicon|appicon|avatar"


def content_kind() -> Column:
    e, w, h = F.lower("ext"), F.col("width"), F.col("height")
    sized = (w > 0) & (h > 0)
    squarish = sized & (F.abs(w - h) <= F.greatest(w, h) * F.lit(0.18))
    small = sized & (w <= 512) & (h <= 512)
    alpha = F.col("has_alpha")
    icon = (e == ".ico") | F.lower("file_name").rlike(ICON_WORDS) | (small & squarish & alpha)
    photo = (w * F.greatest(h, F.lit(1)) >= 500000) & (w >= 800) & (h >= 500)
    return (
        F.when(e == ".svg", "vector")
        .when(e.isin(".exe", ".lnk"), "icon")
        .when(icon, "icon")
        .when(alpha, "transparent_graphic")
        .when(photo, "photo")
        .otherwise("unknown")
    )


# What is recommended for each content kind (primary, secondary).
RECOMMENDED = {
    "photo": ("webp", "jpeg"),
    "transparent_graphic": ("png", "webp"),
    "icon": ("png", "ico"),
    "vector": ("svg", "png"),
}
RECOMMENDED_ELSE = ("webp", "png")


def recommend(kind: Column | str) -> tuple[Column, Column]:
    k = F.col(kind) if isinstance(kind, str) else kind
    primary = secondary = None
    for name, (first, second) in RECOMMENDED.items():
        primary = F.when(k == name, first) if primary is None else primary.when(k == name, first)
        secondary = F.when(k == name, second) if secondary is None else secondary.when(k == name, second)
    return primary.otherwise(RECOMMENDED_ELSE[0]), secondary.otherwise(RECOMMENDED_ELSE[1])


def recommendation_text(primary: Column, secondary: Column) -> Column:
    return F.concat_ws(" / ", F.upper(primary), F.upper(secondary))


def transparency_rule(ext: Column | str = "ext", codec_opaque: Column | None = None) -> Column:
    """True / false where metadata decides, null where the pixels must be read."""
    e = F.lower(F.col(ext)) if isinstance(ext, str) else F.lower(ext)
    opaque = codec_opaque if codec_opaque is not None else F.lit(False)
    return F.when(e == ".svg", True).when(e.isin(".jpg", ".jpeg", ".bmp"), False).when(opaque, False)


def transparency(assets: DataFrame, rasters: DataFrame, codec_opaque: Column | None = None) -> DataFrame:
    """``has_transparency`` per asset.  Rules settle most rows; only undecided ids
    reach the rasters, and the scan of one raster stops at its first clear pixel."""
    ruled = assets.withColumn("_rule", transparency_rule("ext", codec_opaque))
    undecided = ruled.filter(F.col("_rule").isNull()).select("asset_id").distinct()
    seen = (
        rasters.join(undecided, rasters["image_id"] == undecided["asset_id"], "left_semi")
        .groupBy("image_id")
        .agg(F.bool_or(F.exists("px", lambda p: p["a"] < 255)).alias("_seen"))
    )
    return (
        ruled.join(seen, ruled["asset_id"] == seen["image_id"], "left")
        .withColumn("has_transparency", F.coalesce("_rule", "_seen", F.lit(False)))
        .drop("_rule", "_seen", "image_id")
    )


# Extensions the model stages accept.
ENGINE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp"]
NORMALIZABLE_EXTENSIONS = [".bmp", ".tif", ".tiff", ".gif"]


def model_eligible() -> Column:
    still = ~F.col("is_pdf") & (F.col("frame_count") <= 1)
    return still & F.lower("ext").isin(ENGINE_EXTENSIONS + NORMALIZABLE_EXTENSIONS)


def matting_eligible() -> Column:
    """The matting stage takes the same inputs: stills of the listed raster extensions."""
    return model_eligible()


def engine_ready() -> Column:
    """Eligible and readable by the engine without conversion first."""
    return model_eligible() & F.lower("ext").isin(ENGINE_EXTENSIONS)


def needs_unlock() -> Column:
    return F.col("is_encrypted") & ~F.col("is_unlocked")


# Display label of the compression behind an extension.
COMPRESSION_LABELS = {
    ".jpg": "JPEG (lossy)",
    ".jpeg": "JPEG (lossy)",
    ".png": "PNG (lossless)",
    ".webp": "WEBP",
    ".bmp": "BMP",
    ".gif": "GIF",
    ".tif": "TIFF",
    ".tiff": "TIFF",
    ".ico": "ICO",
    ".svg": "SVG (vector)",
    ".psd": "PSD",
}


def compression_label(ext: str = "ext", frames: str = "frame_count") -> Column:
    e = F.lower(ext)
    out = F.when((e == ".webp") & (F.col(frames) > 1), "WEBP (animated)").when(
        (e == ".gif") & (F.col(frames) > 1), "GIF (animated)"
    )
    for name, label in COMPRESSION_LABELS.items():
        out = out.when(e == name, label)
    return out.otherwise(F.upper(F.ltrim(F.col(ext), F.lit("."))))


# Bits per pixel of a decoded colour type.
COLOR_TYPE_BITS = {
    "gray8": 8,
    "alpha8": 8,
    "rgb565": 16,
    "bgra8888": 32,
    "rgba8888": 32,
    "rgb888x": 32,
    "bgra1010102": 32,
    "rgba1010102": 32,
    "rgbaf16": 64,
}


def color_mode(color_type: Column | str, alpha: Column | str = "has_alpha") -> Column:
    t = F.col(color_type) if isinstance(color_type, str) else color_type
    a = F.col(alpha) if isinstance(alpha, str) else alpha
    return (
        F.when(t.isin("gray8", "alpha8"), "Grayscale")
        .when(t.isin("rgb565", "rgb888x"), "RGB")
        .when(a, "RGBA")
        .otherwise("RGB")
    )


def bit_depth(color_type: Column | str) -> Column:
    t = F.col(color_type) if isinstance(color_type, str) else color_type
    out = None
    for name, bits in COLOR_TYPE_BITS.items():
        out = F.when(t == name, bits) if out is None else out.when(t == name, bits)
    return out.cast("bigint")
