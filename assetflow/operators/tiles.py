"""Overlapping scan tiles and duplicate regions of an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.functions.geometry import half_even

# Tile patterns (columns, rows), overlap share and least overlap.
TILE_PATTERNS = [(2, 1), (3, 1), (1, 2), (2, 2), (3, 2)]
TILE_OVERLAP, TILE_OVERLAP_MIN = 0.16, 18


def _span(size: Column, cells: Column, at: Column) -> tuple[Column, Column]:
    cell = size / cells.cast("double")
    overlap = F.greatest(F.lit(TILE_OVERLAP_MIN), half_even(cell * TILE_OVERLAP))
    low = F.greatest(F.lit(0), F.floor(at * cell) - overlap)
    high = F.least(size, F.ceil((at + 1) * cell) + overlap)
    return low.cast("bigint"), high.cast("bigint")


def tile_grid(assets: DataFrame, key: str = "asset_id") -> DataFrame:
    """Every image by every pattern: an array literal of 17 cells, so no join and no shuffle."""
    cells = [
        F.struct(
            F.lit(p).alias("pattern"), F.lit(columns).alias("columns"), F.lit(rows).alias("rows"),
            F.lit(r).alias("row"), F.lit(c).alias("col"),
        )
        for p, (columns, rows) in enumerate(TILE_PATTERNS)
        for r in range(rows)
        for c in range(columns)
    ]
    one = assets.filter((F.col("width") > 0) & (F.col("height") > 0)).select(
        key, "width", "height", F.posexplode(F.array(*cells)).alias("ord", "t")
    )
    left, right = _span(F.col("width"), F.col("t.columns"), F.col("t.col"))
    top, bottom = _span(F.col("height"), F.col("t.rows"), F.col("t.row"))
    tiles = one.select(
        key, F.col("ord").cast("bigint").alias("ord"), F.col("t.pattern").cast("bigint").alias("pattern"),
        left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"),
    )
    return tiles.filter((F.col("w") > 0) & (F.col("h") > 0))


RECT = "array<struct<ord:bigint,x:bigint,y:bigint,w:bigint,h:bigint>>"


def suppress_overlaps(rects: DataFrame, key: str = "asset_id", ratio: float = 0.75) -> DataFrame:
    """Rectangles in order; one that covers an earlier one's area by ``ratio`` (of the
    smaller) is dropped, or takes its slot when it is the smaller.

    The list of one image is bounded by its geometry (17 tiles, or bands of at least 12
    of at most 480 analysis pixels on two axes), so it fits one row and the greedy walk
    is an array fold inside the JVM.
    """
    area = lambda r: r["w"] * r["h"]

    def same(a: Column, b: Column) -> Column:
        across = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
        down = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
        smaller = F.least(F.greatest(area(a), F.lit(1)), area(b)).cast("double")
        return (across > 0) & (down > 0) & (F.try_divide(across * down, smaller) >= ratio)

    def step(kept: Column, r: Column) -> Column:
        hit = F.array_position(F.transform(kept, lambda k: same(k, r)), F.lit(True))
        replaced = F.transform(
            kept, lambda k, i: F.when((i + 1 == hit) & (area(r) < area(k)), r).otherwise(k)
        )
        return F.when(area(r) <= 0, kept).when(hit > 0, replaced).otherwise(F.concat(kept, F.array(r)))

    listed = rects.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "w", "h"))).alias("_all"))
    folded = F.aggregate(F.col("_all").cast(RECT), F.array().cast(RECT), step)
    out = listed.select(key, F.posexplode(folded).alias("slot", "r"))
    return out.select(key, F.col("slot").cast("bigint").alias("slot"), *[F.col(f"r.{c}").alias(c) for c in "xywh"])
