"""Pixel and tensor rules on one array per image.

Arrays stay whole (no explode): each image is one row, so every rule here is a
narrow projection with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_byte(col: Column) -> Column:
    return F.least(F.greatest(col, F.lit(0)), F.lit(255)).cast("bigint")


def round_byte(col: Column) -> Column:
    return clamp_byte(F.round(col).cast("bigint"))


def pixel(p: Column, **changes: Column) -> Column:
    return F.struct(*[changes.get(c, p[c]).alias(c) for c in "rgba"])


# Fixed values of the dark-pixel test.
DARK_ALPHA, DARK_LUMA = 32, 205


def is_dark(p: Column) -> Column:
    luma = F.floor((p["r"] * 299 + p["g"] * 587 + p["b"] * 114) / 1000)
    return (p["a"] > DARK_ALPHA) & (luma < DARK_LUMA)


def dark_pixels(px: Column | str) -> Column:
    return F.transform(px, is_dark)


def posterize_levels(quality: Column) -> Column:
    q = F.least(F.greatest(quality, F.lit(1)), F.lit(100))
    return F.when(q >= 100, None).when(q >= 90, 6).when(q >= 70, 5).when(q >= 50, 4).when(q >= 30, 3).otherwise(2)


def posterize(px: Column | str, quality: Column) -> Column:
    """Fewer colours per channel; clear pixels and quality 100 are left alone."""
    levels = posterize_levels(quality)
    step = F.lit(255.0) / (levels - 1)

    def level(value: Column) -> Column:
        nearest = F.least(F.greatest(F.rint(value / step), F.lit(0.0)), (levels - 1).cast("double"))
        return clamp_byte(F.rint(nearest * step).cast("bigint"))

    changed = F.transform(
        px,
        lambda p: F.when(p["a"] == 0, p).otherwise(pixel(p, r=level(p["r"]), g=level(p["g"]), b=level(p["b"]))),
    )
    return F.when(levels.isNull(), px if isinstance(px, Column) else F.col(px)).otherwise(changed)


# Fixed value: alpha or red from here on counts as selected.
MASK_THRESHOLD = 16


def is_masked(p: Column) -> Column:
    return (p["a"] >= MASK_THRESHOLD) | (p["r"] >= MASK_THRESHOLD)


def threshold_mask(px: Column | str) -> Column:
    return F.transform(px, lambda p: F.when(is_masked(p), 255).otherwise(0).cast("bigint"))


def has_mask(mask: Column | str) -> Column:
    return F.exists(mask, lambda v: v >= MASK_THRESHOLD)


# Input size and per-channel mean / deviation of each matting model.
MATTING_MODELS = {
    "general_classic": (320, 320, True, [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]),
    "general_high_accuracy": (1024, 1024, False, [0.5, 0.5, 0.5], [1.0, 1.0, 1.0]),
    "portrait": (256, 256, False, [0.5, 0.5, 0.5], [0.5, 0.5, 0.5]),
    "anime": (1024, 1024, False, [0.5, 0.5, 0.5], [1.0, 1.0, 1.0]),
}


def tensor_normalize(px: Column | str, mean: list[Column], std: list[Column]) -> Column:
    """Per pixel ``array(r, g, b)`` of ``(c / 255 - mean) / std``."""
    return F.transform(
        px,
        lambda p: F.array(*[(p[c] / F.lit(255.0) - mean[i]) / std[i] for i, c in enumerate("rgb")]),
    )


def apply_mask(px: Column | str, mask: Column | str) -> Column:
    return F.zip_with(px, mask, lambda p, m: pixel(p, a=round_byte(m * (p["a"] / F.lit(255.0)))))


# Fixed values of the edge and blend rules.
EDGE_LOW, EDGE_HIGH, EDGE_WEIGHT = 0.03, 0.97, 0.75
SIGMA_BASE, SIGMA_SPAN = 0.55, 1.85
MIX_BASE, MIX_SPAN = 0.18, 0.36


def blend_sigma(strength: Column) -> Column:
    return F.lit(SIGMA_BASE) + strength / F.lit(100.0) * F.lit(SIGMA_SPAN)


def blend_mix(strength: Column) -> Column:
    return F.lit(MIX_BASE) + strength / F.lit(100.0) * F.lit(MIX_SPAN)


def soften(mask: Column | str, blurred: Column | str, strength: Column) -> Column:
    """Edge values move towards the blurred mask; both masks are bytes."""
    weight = F.least(F.greatest(strength / F.lit(100.0), F.lit(0.0)), F.lit(1.0)) * F.lit(EDGE_WEIGHT)

    def one(m: Column, s: Column) -> Column:
        original, soft = m / F.lit(255.0), s / F.lit(255.0)
        w = F.when((original > EDGE_LOW) & (original < EDGE_HIGH), weight).otherwise(F.lit(0.0))
        return round_byte(F.round((original + (soft - original) * w) * 255.0, 6))

    return F.zip_with(mask, blurred, one)


def blend_mask(mask: Column | str, smooth: Column | str, strength: Column) -> Column:
    mix = blend_mix(strength)

    def one(m: Column, s: Column) -> Column:
        value = F.least(
            F.greatest(m / F.lit(255.0) * (1 - mix) + s / F.lit(255.0) * mix, F.lit(0.0)), F.lit(1.0)
        )
        return round_byte(F.round(value * 255.0, 6))

    mask_col = F.col(mask) if isinstance(mask, str) else mask
    return F.when(strength <= 0, mask_col).otherwise(F.zip_with(mask, smooth, one))


def lerp(start: Column, end: Column, amount: Column) -> Column:
    return round_byte(F.round(start + (end - start) * amount, 6))


def lerp_blend(source: Column | str, result: Column | str, mask: Column | str) -> Column:
    """Result over source where the mask (bytes) says so; output is opaque."""
    pairs = F.zip_with(source, result, lambda s, r: F.struct(s.alias("s"), r.alias("r")))

    def one(p: Column, m: Column) -> Column:
        amount = m / F.lit(255.0)
        return F.struct(
            *[lerp(p["s"][c], p["r"][c], amount).alias(c) for c in "rgb"], F.lit(255).cast("bigint").alias("a")
        )

    return F.zip_with(pairs, mask, one)


def composite_background(px: Column | str, colour: tuple[Column, Column, Column]) -> Column:
    """Source over an opaque colour."""

    def one(p: Column) -> Column:
        keep = p["a"] / F.lit(255.0)
        return F.struct(
            *[
                round_byte(F.round(p[c] * keep + colour[i] * (1 - keep), 6)).alias(c)
                for i, c in enumerate("rgb")
            ],
            F.lit(255).cast("bigint").alias("a"),
        )

    return F.transform(px, one)


def argb_channels(text: Column) -> tuple[Column, Column, Column]:
    """Red, green, blue of ``#AARRGGBB`` (anything else is white)."""
    good = text.rlike("^#[0-9A-Fa-f]{8}$")
    safe = F.when(good, text).otherwise(F.lit("#FFFFFFFF"))
    return tuple(F.conv(F.substring(safe, at, 2), 16, 10).cast("bigint") for at in (4, 6, 8))


def minmax_normalize(values: Column | str) -> Column:
    low, high = F.array_min(values), F.array_max(values)
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    v = F.col(values) if isinstance(values, str) else values
    return (
        F.when((low >= 0) & (high <= 1), v)
        .when(high - low < 1e-6, F.transform(v, unit))
        .otherwise(F.transform(v, lambda x: unit((x - low) * F.try_divide(F.lit(1.0), high - low))))
    )


def descale(values: Column | str) -> Column:
    unit = F.forall(values, lambda x: (x >= 0) & (x <= 1))
    scale = F.when(unit, 255.0).otherwise(1.0)
    return F.transform(values, lambda x: round_byte(F.round(x * scale, 6)))


def tensor_shape(dims: Column, channels_limit: int = 4) -> Column:
    """``struct(width, height, layout)`` of a mask tensor from its dimensions, else null."""
    at = lambda i: F.greatest(F.get(dims, F.lit(i)), F.lit(1)).cast("bigint")
    small = lambda i: F.get(dims, F.lit(i)).between(1, channels_limit)
    shape = lambda w, h, name: F.struct(w.alias("width"), h.alias("height"), F.lit(name).alias("layout"))
    rank = F.size(dims)
    return (
        F.when((rank == 4) & small(1), shape(at(3), at(2), "nchw"))
        .when((rank == 4) & small(3), shape(at(2), at(1), "nhwc"))
        .when(
            (rank == 3) & small(0) & (F.get(dims, F.lit(1)) > channels_limit) & (F.get(dims, F.lit(2)) > channels_limit),
            shape(at(2), at(1), "chw"),
        )
        .when((rank == 3) & small(2), shape(at(1), at(0), "hwc"))
        .when(rank == 3, shape(at(2), at(1), "bhw"))
        .when(rank == 2, shape(at(1), at(0), "hw"))
    )


def image_shape(dims: Column) -> Column:
    """As :func:`tensor_shape` for colour output; a third of the layouts need 1-4 channels."""
    at = lambda i: F.greatest(F.get(dims, F.lit(i)), F.lit(1)).cast("bigint")
    small = lambda i: F.get(dims, F.lit(i)).between(1, 4)
    shape = lambda w, h, c, name: F.struct(
        w.alias("width"), h.alias("height"), c.alias("channels"), F.lit(name).alias("layout")
    )
    rank = F.size(dims)
    return (
        F.when((rank == 4) & small(1), shape(at(3), at(2), at(1), "nchw"))
        .when((rank == 4) & small(3), shape(at(2), at(1), at(3), "nhwc"))
        .when((rank == 3) & small(0), shape(at(2), at(1), at(0), "chw"))
        .when((rank == 3) & small(2), shape(at(1), at(0), at(2), "hwc"))
    )


def largest_candidate(candidates: Column) -> Column:
    """The shape with most pixels, the first on ties; null ones are skipped."""
    known = F.filter(candidates, lambda s: s.isNotNull())
    ranked = F.transform(
        known, lambda s, i: F.struct((s["width"] * s["height"]).alias("n"), (-i).alias("o"), s.alias("s"))
    )
    return F.array_max(ranked)["s"]


def mean_confidence(scores: Column, box_score: Column) -> Column:
    """Mean of the finite character scores, else of the finite box score, within 0..1; none gives 0."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    chosen = F.filter(F.when(F.size(scores) > 0, scores).otherwise(F.array(box_score)), finite)
    total = F.aggregate(chosen, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.try_divide(total, F.size(chosen))
    return F.coalesce(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def mask_metrics(mask: Column | str) -> dict[str, Column]:
    """Mean alpha and foreground share in percent of a byte mask."""
    n = F.size(mask)
    total = F.aggregate(mask, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    shown = F.size(F.filter(mask, lambda v: v >= MASK_THRESHOLD))
    zero = F.lit(0.0)
    return {
        "mean_alpha_pct": F.coalesce(F.try_divide(total * F.lit(100.0), n * F.lit(255.0)), zero),
        "foreground_pct": F.coalesce(F.try_divide(shown * F.lit(100.0), n), zero),
    }
