"""Neighbourhood and region rules on rasters kept as one array per image.

An image is one row, so none of these shuffles; ``pixel_rows`` unfolds a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.functions.geometry import half_even
from assetflow.functions.raster import is_dark


def pixel_rows(df: DataFrame, px: str, fields: str | None = "rgba", key: str = "image_id") -> DataFrame:
    """``key, x, y`` and the channels (or ``value``) of each pixel."""
    out = df.select(key, "width", F.posexplode(px).alias("_i", "_p"))
    cells = [F.col(f"_p.{c}").alias(c) for c in fields] if fields else [F.col("_p").alias("value")]
    return out.select(
        key, (F.col("_i") % F.col("width")).cast("bigint").alias("x"),
        F.expr("_i div width").cast("bigint").alias("y"), *cells,
    )


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.  Catalyst inlines a projected array
    into every lambda that reads it; as a lambda variable it is evaluated a single time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(values: Column, index: Column) -> Column:
    return F.get(values, index.cast("int"))


def _indices(count: Column) -> Column:
    """0 .. count-1 (empty for 0)."""
    return F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)).otherwise(
        F.array().cast("array<bigint>")
    )


# sample comparison ---------------------------------------------------------

# Where two renditions are compared, as shares of width and height.
SAMPLE_POINTS = [(0.18, 0.21), (0.33, 0.67), (0.50, 0.50), (0.72, 0.28), (0.84, 0.79)]


def _sample(px: Column, width: Column, height: Column, sx: float, sy: float) -> Column:
    def spot(size: Column, share: float) -> Column:
        last = F.greatest(size - 1, F.lit(0))
        return F.least(F.greatest(F.round(last * F.lit(share)).cast("bigint"), F.lit(0)), last)

    return _at(px, spot(height, sy) * width + spot(width, sx))


def compare_samples(first: DataFrame, second: DataFrame) -> DataFrame:
    """``image_id, point, delta`` and both colours at five fixed points.  The points are a
    literal array; the only join is image to image."""
    a = first.select("image_id", F.col("width").alias("_wa"), F.col("height").alias("_ha"), F.col("px").alias("_a"))
    b = second.select("image_id", F.col("width").alias("_wb"), F.col("height").alias("_hb"), F.col("px").alias("_b"))
    pairs = []
    for n, (sx, sy) in enumerate(SAMPLE_POINTS):
        pa = _sample(F.col("_a"), F.col("_wa"), F.col("_ha"), sx, sy)
        pb = _sample(F.col("_b"), F.col("_wb"), F.col("_hb"), sx, sy)
        pairs.append(F.struct(
            F.lit(n).cast("bigint").alias("point"),
            F.concat(F.lit(f"@{round(sx * 100)}%,{round(sy * 100)}%")).alias("label"),
            pa.alias("a"), pb.alias("b"),
        ))
    rows = a.join(b, "image_id").select("image_id", F.explode(F.array(*pairs)).alias("s"))
    delta = sum((F.abs(F.col(f"s.a.{c}") - F.col(f"s.b.{c}")) for c in "rgb"), F.lit(0).cast("bigint"))
    return rows.select("image_id", "s.point", "s.label", "s.a", "s.b", delta.alias("delta")).filter(
        F.col("a").isNotNull() & F.col("b").isNotNull()
    )


def best_sample(samples: DataFrame) -> DataFrame:
    """The point with the largest delta per image, the first one on ties."""
    best = samples.groupBy("image_id").agg(
        F.max_by(F.struct("point", "label", "a", "b", "delta"), F.struct("delta", -F.col("point"))).alias("s")
    )
    rgb = lambda p: F.concat(F.lit("("), F.concat_ws(",", *[F.col(f"s.{p}.{c}") for c in "rgb"]), F.lit(")"))
    summary = F.concat(
        F.col("s.label"), F.lit(" RGB "), rgb("a"), F.lit(" -> "), rgb("b"), F.lit(", delta="), F.col("s.delta")
    )
    return best.select("image_id", F.col("s.point").alias("point"), F.col("s.delta").alias("delta"), summary.alias("summary"))


def blend_join(source: DataFrame, result: DataFrame, mask: DataFrame) -> DataFrame:
    """Source, result and mask of each image side by side; arrays are aligned by position."""
    return (
        source.select("image_id", "width", "height", F.col("px").alias("source_px"))
        .join(result.select("image_id", F.col("px").alias("result_px")), "image_id")
        .join(mask.select("image_id", "mask"), "image_id")
    )


# windows of pixels -----------------------------------------------------------

def _line_fold(values: Column, width: Column, height: Column, n: Column, fold) -> Column:
    """Fold each pixel with its row neighbours up to ``n`` away."""
    def one(v: Column, i: Column) -> Column:
        x = i % width
        low = F.greatest(x - n, F.lit(0))
        high = F.least(x + n, width - 1)
        return fold(F.slice(values, (i - x + low + 1).cast("int"), (high - low + 1).cast("int")))

    return F.transform(values, one)


def _column_fold(values: Column, width: Column, height: Column, n: Column, fold) -> Column:
    def one(v: Column, i: Column) -> Column:
        y = F.floor(i / width)
        low = F.greatest(y - n, F.lit(0))
        high = F.least(y + n, height - 1)
        return fold(F.transform(F.sequence(low, high), lambda k: _at(values, k * width + i % width)))

    return F.transform(values, one)


def dilate_mask(masks: DataFrame, n: int) -> DataFrame:
    """A mask (bytes) grown by a square of ``n`` pixels, then thresholded; rows, then columns."""
    if n <= 0:
        return masks
    count, w, h = F.lit(n).cast("bigint"), F.col("width"), F.col("height")
    wide = bind(F.col("mask"), lambda m: _line_fold(m, w, h, count, F.array_max))
    tall = bind(wide, lambda m: _column_fold(m, w, h, count, F.array_max))
    grown = F.transform(tall, lambda v: F.when(v >= 16, 255).otherwise(0).cast("bigint"))
    return masks.withColumn("mask", grown)


def box_mean(df: DataFrame, column: str, n: int, out: str) -> DataFrame:
    """Mean of the square of ``2n+1`` pixels around each, cut at the borders, as a byte."""
    count, w, h = F.lit(n).cast("bigint"), F.col("width"), F.col("height")
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    rows = bind(F.col(column), lambda m: _line_fold(m, w, h, count, total))
    squares = bind(rows, lambda m: _column_fold(m, w, h, count, total))

    def mean(v: Column, i: Column) -> Column:
        x, y = i % w, F.floor(i / w)
        nx = F.least(x + n, w - 1) - F.greatest(x - n, F.lit(0)) + 1
        ny = F.least(y + n, h - 1) - F.greatest(y - n, F.lit(0)) + 1
        return F.round(F.round(v / (nx * ny).cast("double"), 6)).cast("bigint")

    return df.withColumn(out, F.transform(squares, mean))


def resample(rasters: DataFrame, target_width: str, target_height: str) -> DataFrame:
    """Area mean: a target pixel is the mean of the source pixels it covers (at least one)."""
    w, h, tw, th = (F.col(c) for c in ("width", "height", target_width, target_height))
    cover = lambda t, size, target: (
        F.floor(t * size / target),
        F.greatest(F.floor(t * size / target) + 1, F.ceil((t + 1) * size / target)),
    )

    def cell(px: Column, t: Column) -> Column:
        x0, x1 = cover(t % tw, w, tw)
        y0, y1 = cover(F.floor(t / tw), h, th)
        covered = F.flatten(F.transform(
            F.sequence(y0, y1 - 1), lambda y: F.slice(px, (y * w + x0 + 1).cast("int"), (x1 - x0).cast("int"))
        ))

        def mean(block: Column) -> Column:
            n = F.size(block).cast("double")
            total = lambda c: F.aggregate(block, F.lit(0).cast("bigint"), lambda acc, p: acc + p[c])
            return F.struct(*[F.round(F.round(total(c) / n, 6)).cast("bigint").alias(c) for c in "rgba"])

        return bind(covered, mean)

    out = rasters.withColumn(
        "_px", bind(F.col("px"), lambda px: F.transform(_indices(tw * th), lambda t: cell(px, t)))
    )
    return out.select("image_id", tw.alias("width"), th.alias("height"), F.col("_px").alias("px"))


# dark bands --------------------------------------------------------------------

# Fixed values of the band search.
ANALYSIS_EDGE = 480


def analysis_size(width: Column, height: Column) -> tuple[Column, Column]:
    longest = F.greatest(width, height)
    scale = F.try_divide(F.lit(float(ANALYSIS_EDGE)), longest)
    fit = lambda v: F.when(longest <= ANALYSIS_EDGE, v).otherwise(F.greatest(half_even(v * scale), F.lit(1)))
    return fit(width).cast("bigint"), fit(height).cast("bigint")


def _dark_counts(dark: Column, width: Column, height: Column, columns: bool, low: Column, high: Column) -> Column:
    """Per index of one axis: dark pixels whose other index is in ``low .. high-1``."""
    if columns:
        span = F.sequence(low, high - 1)
        return F.transform(
            _indices(width),
            lambda x: F.size(F.filter(span, lambda y: _at(dark, y * width + x))).cast("bigint"),
        )
    return F.transform(
        _indices(height),
        lambda y: F.size(F.filter(
            F.slice(dark, (y * width + low + 1).cast("int"), (high - low).cast("int")), lambda d: d
        )).cast("bigint"),
    )


BAND = "struct<open:bigint,found:array<struct<start:bigint,end:bigint>>>"


def _runs(active: Column, least: Column) -> Column:
    """Maximal runs of true of at least ``least`` entries, as ``(start, end)``."""
    none = F.lit(-1).cast("bigint")
    marked = F.transform(
        F.concat(active, F.array(F.lit(False))),
        lambda a, i: F.struct(a.alias("a"), i.cast("bigint").alias("i")),
    )

    def step(acc: Column, m: Column) -> Column:
        closes = ~m["a"] & (acc["open"] >= 0)
        kept = closes & (m["i"] - acc["open"] >= least)
        run = F.array(F.struct(acc["open"].alias("start"), m["i"].alias("end")))
        opened = F.when(m["a"], F.when(acc["open"] < 0, m["i"]).otherwise(acc["open"])).otherwise(none)
        found = F.when(kept, F.concat(acc["found"], run)).otherwise(acc["found"])
        return F.struct(opened.alias("open"), found.alias("found")).cast(BAND)

    start = F.struct(none.alias("open"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("found")).cast(BAND)
    return F.aggregate(marked, start, step)["found"]


def axis_bands(rasters: DataFrame) -> DataFrame:
    """``image_id, axis, start, end``: runs of columns and of rows that are dark enough."""
    w, h = F.col("width"), F.col("height")
    zero = F.lit(0).cast("bigint")

    def bands(dark: Column, columns: bool) -> Column:
        length, other = (w, h) if columns else (h, w)
        active_from = F.greatest(F.lit(3), F.floor(other / 22))
        least = F.greatest(F.lit(12), F.floor(length / 14))
        counts = _dark_counts(dark, w, h, columns, zero, other)
        return _runs(F.transform(counts, lambda n: n >= active_from), least)

    def tagged(found: Column, axis: str) -> Column:
        return F.transform(
            found, lambda b: F.struct(F.lit(axis).alias("axis"), b["start"].alias("start"), b["end"].alias("end"))
        )

    both = bind(
        F.transform("px", is_dark),
        lambda dark: F.concat(tagged(bands(dark, True), "column"), tagged(bands(dark, False), "row")),
    )
    return rasters.select(*rasters.columns, F.explode(both).alias("_b")).select(
        *rasters.columns, "_b.axis", "_b.start", "_b.end"
    )


def dark_range(bands: DataFrame, source_width: str, source_height: str) -> DataFrame:
    """The dark extent of each band on the other axis, mapped with padding to a source
    rectangle ``x, y, w, h``; bands without one are dropped."""
    w, h, start, end = F.col("width"), F.col("height"), F.col("start"), F.col("end")
    active_from = F.greatest(F.lit(3), F.floor(F.greatest(end - start, F.lit(1)) / 18))
    is_column = F.col("axis") == "column"
    counts = bind(
        F.transform("px", is_dark),
        lambda dark: F.when(is_column, _dark_counts(dark, w, h, False, start, end)).otherwise(
            _dark_counts(dark, w, h, True, start, end)
        ),
    )
    hits = F.filter(
        F.transform(counts, lambda n, i: F.when(n >= active_from, i.cast("bigint"))), lambda i: i.isNotNull()
    )
    found = bands.withColumn("_hits", hits).filter(F.size("_hits") > 0).withColumns({
        "range_start": F.array_min("_hits"), "range_end": F.array_max("_hits") + 1,
    })
    return map_ranges(found, source_width, source_height)


def map_ranges(found: DataFrame, source_width: str, source_height: str) -> DataFrame:
    """Bands with their extent (``range_start, range_end``) as padded rectangles of the source."""
    w, h, start, end = F.col("width"), F.col("height"), F.col("start"), F.col("end")
    is_column = F.col("axis") == "column"
    left = F.when(is_column, start).otherwise(F.col("range_start"))
    right = F.when(is_column, end).otherwise(F.col("range_end"))
    top = F.when(is_column, F.col("range_start")).otherwise(start)
    bottom = F.when(is_column, F.col("range_end")).otherwise(end)

    def mapped(low: Column, high: Column, source: str, size: Column) -> tuple[Column, Column]:
        scale = F.col(source) / size.cast("double")
        pad = F.greatest(F.lit(14), half_even(scale * 10))
        a = F.greatest(F.lit(0), F.floor(low * scale) - pad)
        b = F.least(F.col(source), F.ceil(high * scale) + pad)
        return a.cast("bigint"), F.greatest(F.lit(1), b - a).cast("bigint")

    x, rect_w = mapped(left, right, source_width, w)
    y, rect_h = mapped(top, bottom, source_height, h)
    return found.select(
        "image_id", "axis", "start", "end", "range_start", "range_end",
        x.alias("x"), y.alias("y"), rect_w.alias("w"), rect_h.alias("h"),
    )
