"""Sizes, scales and index clamps.

Half-even rounding is ``rint`` (exact on doubles, stays in generated code); away
from zero is ``round``.  Divisions go through ``try_divide`` so an empty image can
never fail a task under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetflow.functions.options import clamp


def half_even(col: Column) -> Column:
    return F.rint(col).cast("bigint")


def away(col: Column) -> Column:
    return F.round(col).cast("bigint")


def at_least_one(col: Column) -> Column:
    return F.greatest(col, F.lit(1).cast("bigint"))


def target_dimensions(width: str = "width", height: str = "height") -> tuple[Column, Column]:
    """Output size under the job's resize mode; an invalid source gives 1 x 1."""
    w, h = F.col(width), F.col(height)
    rw, rh, pct = F.col("resize_width"), F.col("resize_height"), F.col("resize_percent")
    mode = F.col("resize_mode")
    invalid = (w < 1) | (h < 1)
    out_w = (
        F.when(invalid, F.lit(1))
        .when(mode.isin("fixed_width", "custom_size"), at_least_one(rw))
        .when(mode == "fixed_height", at_least_one(half_even(w * F.try_divide(rh, h))))
        .when(mode == "scale_percent", at_least_one(half_even(w * pct / F.lit(100.0))))
        .otherwise(w)
    )
    out_h = (
        F.when(invalid, F.lit(1))
        .when(mode.isin("fixed_height", "custom_size"), at_least_one(rh))
        .when(mode == "fixed_width", at_least_one(half_even(h * F.try_divide(rw, w))))
        .when(mode == "scale_percent", at_least_one(half_even(h * pct / F.lit(100.0))))
        .otherwise(h)
    )
    return out_w.cast("bigint"), out_h.cast("bigint")


# Requested scales lie in 2..16, every inference pass multiplies by 4.
MIN_SCALE, MAX_SCALE, PASS_SCALE = 2, 16, 4


def scale_plan(requested: str = "model_scale", width: str = "width", height: str = "height") -> dict[str, Column]:
    scale = clamp(requested, MIN_SCALE, MAX_SCALE)
    second = scale > PASS_SCALE
    raw = F.when(second, PASS_SCALE * PASS_SCALE).otherwise(PASS_SCALE)

    def final(dim: str) -> Column:
        source = F.col(dim)
        by_ratio = away(F.greatest(source, F.lit(0)) * raw * (scale / raw))
        return F.when(source > 0, source * scale).otherwise(at_least_one(by_ratio)).cast("bigint")

    return {
        "scale": scale.cast("bigint"),
        "inference_scale": F.lit(PASS_SCALE).cast("bigint"),
        "needs_second_pass": second,
        "raw_scale": raw.cast("bigint"),
        "final_width": final(width),
        "final_height": final(height),
    }


def final_dimension(source: Column, enhanced: Column, scale: Column, raw: Column) -> Column:
    """Size after post-processing; without a known source it follows the enhanced raster."""
    ratio = scale.cast("double") / F.greatest(raw, F.lit(1))
    return F.when(source > 0, source * scale).otherwise(at_least_one(away(enhanced * ratio))).cast("bigint")


def clamp_index(index: Column | str, count: Column | str) -> Column:
    n = F.col(count) if isinstance(count, str) else count
    return clamp(index, 0, F.greatest(n - 1, F.lit(0))).cast("bigint")


def clamp_range(start: Column, end: Column, count: Column) -> tuple[Column, Column]:
    last = F.greatest(count - 1, F.lit(0))
    low = F.least(F.greatest(start, F.lit(0)), last)
    high = F.least(F.greatest(end, low), last)
    return low.cast("bigint"), high.cast("bigint")


def page_image_mode(pages: Column | str = "page_count") -> Column:
    n = F.col(pages) if isinstance(pages, str) else pages
    return F.when(n <= 1, "current_page").otherwise(F.col("pdf_image_mode"))


def page_document_mode(pages: Column | str = "page_count") -> Column:
    n = F.col(pages) if isinstance(pages, str) else pages
    return F.when(n <= 1, "all_pages").otherwise(F.col("pdf_doc_mode"))


# Page sizes in millimetres, matched in this order within 6 mm.
PAGE_SIZES = [
    ("A5", 148.0, 210.0),
    ("A4", 210.0, 297.0),
    ("A3", 297.0, 420.0),
    ("Letter", 215.9, 279.4),
    ("Legal", 215.9, 355.6),
]
PAGE_TOLERANCE_MM = 6.0


def points_to_mm(points: Column) -> Column:
    return points * F.lit(25.4) / F.lit(72.0)


def page_size_class(width_pt: str, height_pt: str) -> Column:
    w, h = points_to_mm(F.col(width_pt)), points_to_mm(F.col(height_pt))

    def near(a: float, b: float) -> Column:
        return (F.abs(w - a) <= PAGE_TOLERANCE_MM) & (F.abs(h - b) <= PAGE_TOLERANCE_MM)

    out = None
    for name, a, b in PAGE_SIZES:
        test = near(a, b) | near(b, a)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


# Fixed values of the fit rules.
ICON_EDGE = 256
DECODE_MIN, DECODE_MAX, OVERSCAN = 2048, 4096, 3.0
PREVIEW_SCALE = (0.4, 4.0)
EXPORT_BASE, EXPORT_MAX = 2.0, 6.0
UPSCALE_WORTH = 1.05


def icon_box(width: Column, height: Column) -> dict[str, Column]:
    """Centered placement on a square canvas of at most 256 px (single precision scale)."""
    longest = F.greatest(width, height)
    side = F.least(F.lit(ICON_EDGE), longest)
    scale = F.least(
        F.try_divide(side, width).cast("float"), F.try_divide(side, height).cast("float")
    ).cast("double")
    draw_w, draw_h = at_least_one(half_even(width * scale)), at_least_one(half_even(height * scale))
    return {
        "icon_side": side.cast("bigint"),
        "icon_width": draw_w,
        "icon_height": draw_h,
        "icon_x": (side - draw_w) / F.lit(2.0),
        "icon_y": (side - draw_h) / F.lit(2.0),
    }


def letterbox(width: Column, height: Column, box_w: int, box_h: int) -> dict[str, Column]:
    """Aspect-preserving fit into a fixed box, integer offsets."""
    scale = F.least(F.try_divide(F.lit(float(box_w)), width), F.try_divide(F.lit(float(box_h)), height))
    w, h = at_least_one(away(width * scale)), at_least_one(away(height * scale))
    return {
        "fit_width": w,
        "fit_height": h,
        "fit_x": ((box_w - w) / F.lit(2)).cast("bigint"),
        "fit_y": ((box_h - h) / F.lit(2)).cast("bigint"),
    }


def downscale(width: Column, height: Column, limit: int) -> dict[str, Column]:
    longest = F.greatest(width, height)
    keep = (longest <= limit) if limit > 0 else F.lit(True)
    scale = F.try_divide(F.lit(float(limit)), longest)
    return {
        "max_width": F.when(keep, width).otherwise(at_least_one(away(width * scale))).cast("bigint"),
        "max_height": F.when(keep, height).otherwise(at_least_one(away(height * scale))).cast("bigint"),
    }


def decode_width(source_width: Column, viewport: float, rendering: float) -> Column:
    wanted = F.ceil(F.lit(max(1.0, viewport) * max(1.0, rendering) * OVERSCAN))
    width = clamp(wanted, DECODE_MIN, DECODE_MAX)
    return F.when(source_width > 0, F.least(source_width, width)).otherwise(width).cast("bigint")


def preview_scale(source_width: Column, target: int) -> Column:
    ratio = F.try_divide(F.lit(float(max(1, target))), at_least_one(source_width))
    return clamp(ratio, PREVIEW_SCALE[0], PREVIEW_SCALE[1])


def export_scale(source_width: Column, minimum: int) -> Column:
    wanted = F.greatest(F.lit(max(1, minimum)), F.ceil(source_width * F.lit(EXPORT_BASE)))
    return clamp(wanted / at_least_one(source_width).cast("double"), 1.0, EXPORT_MAX)


def upscale_plan(width: Column, height: Column, longest_target: int) -> dict[str, Column]:
    longest = F.greatest(width, height)
    scale = F.greatest(F.lit(1.0), F.try_divide(F.lit(float(longest_target)), longest))
    worth = (longest > 0) & (scale > UPSCALE_WORTH)
    return {
        "upscale_worth": F.coalesce(worth, F.lit(False)),
        "upscale_width": F.when(worth, at_least_one(half_even(width * scale))),
        "upscale_height": F.when(worth, at_least_one(half_even(height * scale))),
    }
