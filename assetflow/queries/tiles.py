"""The raster rules on tiles: images of 64 x 64 pixels made from 64 vectors each, in tiles of 24."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.operators import pixels as P
from assetflow.operators import tiled
from assetflow.queries.base import query, rounded
from assetflow.queries.rasters import STRIPES_SQL, _level
from assetflow.session import scratch_path, table

SIZE = 24
MOSAIC = """WITH pixels AS (SELECT image_id, x, y, r, (r * 7) % 256 AS g, (r * 13) % 256 AS b, CASE WHEN r % 5 = 0 THEN 0 ELSE 255 END AS a
  FROM (SELECT vec_id // 64 AS image_id, i - 1 AS x, vec_id % 64 AS y, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 127) AS BIGINT) AS r
    FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)))
"""


LINES = 1024  # vectors painted at once


def _painter(pixel):
    """Vectors to packed lines of pixels, some at a time: a task never holds an image's numbers as Python objects."""

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LINES):
                part = batch.slice(at, LINES)
                v = np.asarray(part.column("v").flatten(), np.float64).reshape(part.num_rows, 64)
                px = np.stack(pixel(v, np.asarray(part.column("y"))), 2).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column("image_id"), part.column("y"), pa.array([line.tobytes() for line in px], pa.binary())], names=["image_id", "y", "line"])

    return paint


def _stacked(spark, sf, pixel) -> DataFrame:
    """``image_id, width, height, data`` of rasters with a row for each vector; ``pixel(vectors, rows)`` gives the four channels."""
    rows = table(spark, sf, "embeddings").select(F.expr("vec_id div 64").cast("bigint").alias("image_id"), (F.col("vec_id") % 64).cast("bigint").alias("y"), F.col("embedding").alias("v"))
    lines = rows.mapInArrow(_painter(pixel), "image_id bigint, y bigint, line binary")
    images = lines.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "line"))).alias("rows"))  # 64 rows at most
    data = F.aggregate("rows", F.lit(b""), lambda acc, r: F.concat(acc, r["line"]))
    return images.select("image_id", F.lit(64).cast("bigint").alias("width"), F.size("rows").cast("bigint").alias("height"), data.alias("data"))


def _mosaic(v, y):
    r = np.floor((v + 1) * 127).astype(np.int64)
    return r, r * 7 % 256, r * 13 % 256, np.where(r % 5 == 0, 0, 255)


def _striped(v, y):
    shade = np.where((y[:, None] // 16 % 2 == 0) & (np.arange(64) // 20 % 2 == 0) & (v > 0), 40, 250)
    return shade, shade, shade, np.full_like(shade, 255)


def _tiles(spark, sf, pixel=_mosaic):
    return tiled.cut_tiles(_stacked(spark, sf, pixel), SIZE)


def _channel(i: int):
    return lambda px: px[..., i : i + 1]


def _case(sql: str) -> str:
    return (MOSAIC + sql).replace("count_if(", "count(*) FILTER (WHERE ")


@query(_case("SELECT image_id, x, y, CASE WHEN a > 32 AND (r * 299 + g * 587 + b * 114) // 1000 < 205 THEN 1 ELSE 0 END::BIGINT AS value FROM pixels"))
def tiled_dark_pixels(spark, sf):
    return tiled.tile_pixels(tiled.map_tiles(_tiles(spark, sf), lambda px: tiled.dark(px)[..., None]), None)


@query(_case(f"SELECT image_id, x, y, {_level('r')} AS r, {_level('g')} AS g, {_level('b')} AS b, CAST(a AS BIGINT) AS a FROM pixels"))
def tiled_posterize(spark, sf):
    return tiled.tile_pixels(tiled.map_tiles(_tiles(spark, sf), tiled.posterize, (F.col("image_id") * 13) % 110))


@query(_case("SELECT image_id, count_if(a >= 16 OR r >= 16) AS masked FROM pixels GROUP BY image_id"))
def tiled_threshold_mask(spark, sf):
    masks = tiled.tile_pixels(tiled.map_tiles(_tiles(spark, sf), tiled.threshold_mask), None)
    return masks.groupBy("image_id").agg(F.count_if(F.col("value") == 255).alias("masked"))


@query(_case("SELECT image_id, x, y, least(greatest(CAST(round(g * (a / 255.0::DOUBLE)) AS BIGINT), 0), 255) AS a FROM pixels"))
def tiled_apply_mask(spark, sf):
    tiles = _tiles(spark, sf)
    masked = tiled.map_tiles(tiles, tiled.apply_mask, others={"mask": tiled.map_tiles(tiles, _channel(1))})
    return tiled.tile_pixels(masked).select("image_id", "x", "y", "a")


@query(_case("SELECT image_id, x, y, " + ", ".join(
    f"least(greatest(CAST(round(round({c} * (a / 255.0::DOUBLE) + {v} * (1 - a / 255.0::DOUBLE), 6)) AS BIGINT), 0), 255) AS {c}" for c, v in zip("rgb", (16, 32, 171))
) + ", CAST(255 AS BIGINT) AS a FROM pixels"))
def tiled_composite_background(spark, sf):
    return tiled.tile_pixels(tiled.map_tiles(_tiles(spark, sf), tiled.composite, F.lit(16), F.lit(32), F.lit(171)))


BLUR_SQL = """, blur AS (SELECT p.image_id, p.x, p.y, any_value(p.r) AS m, CAST(round(round(avg(n.r), 6)) AS BIGINT) AS s
  FROM pixels p JOIN pixels n ON n.image_id = p.image_id AND abs(n.x - p.x) <= 3 AND abs(n.y - p.y) <= 3 GROUP BY p.image_id, p.x, p.y)
"""


def _smooth(spark, sf):
    mask = tiled.map_tiles(_tiles(spark, sf), _channel(0))
    return mask, tiled.box_mean(mask, 3)


@query(_case(BLUR_SQL + """
SELECT image_id, x, y, least(greatest(CAST(round(round((m / 255.0::DOUBLE + (s / 255.0::DOUBLE - m / 255.0::DOUBLE) * CASE WHEN m / 255.0::DOUBLE > 0.03 AND m / 255.0::DOUBLE < 0.97 THEN 0.75::DOUBLE * (image_id % 101) / 100 ELSE 0 END) * 255, 6)) AS BIGINT), 0), 255) AS value FROM blur"""))
def tiled_soften_edges(spark, sf):
    mask, smooth = _smooth(spark, sf)
    return tiled.tile_pixels(tiled.map_tiles(mask, tiled.soften, F.col("image_id") % 101, others={"smooth": smooth}), None)


@query(_case(BLUR_SQL + ", po AS (SELECT *, " + ", ".join(f"{_level(c, '40')} AS {c}2" for c in "rgb") + " FROM pixels) SELECT po.image_id, po.x, po.y, " + ", ".join(
    f"least(greatest(CAST(round(round({c} + ({c}2 - {c}) * (s / 255.0::DOUBLE), 6)) AS BIGINT), 0), 255) AS {c}" for c in "rgb"
) + " FROM po JOIN blur USING (image_id, x, y)"))
def tiled_lerp_blend(spark, sf):
    tiles, (_, smooth) = _tiles(spark, sf), _smooth(spark, sf)
    result = tiled.map_tiles(tiles, tiled.posterize, F.lit(40))
    return tiled.tile_pixels(tiled.map_tiles(tiles, tiled.lerp_blend, others={"result": result, "mask": smooth})).drop("a")


@query(_case("""
SELECT p.image_id, p.x, p.y, CASE WHEN max(CASE WHEN n.a >= 16 AND n.r > 200 THEN 255 ELSE 0 END) >= 16 THEN 255 ELSE 0 END::BIGINT AS value
FROM pixels p JOIN pixels n ON n.image_id = p.image_id AND abs(n.x - p.x) <= 5 AND abs(n.y - p.y) <= 5 GROUP BY p.image_id, p.x, p.y"""))
def tiled_dilate_mask(spark, sf):
    masks = tiled.map_tiles(_tiles(spark, sf), lambda px: np.where((px[..., 3:] >= 16) & (px[..., :1] > 200), 255, 0))
    return tiled.tile_pixels(tiled.dilate_mask(masks, 5), None)


@query(_case("""
, s AS (SELECT image_id, max(y) + 1 AS h, 20 + image_id % 61 AS tw, 30 + image_id % 41 AS th FROM pixels GROUP BY image_id),
t AS (SELECT *, unnest(range(0, th)) AS ty FROM (SELECT *, unnest(range(0, tw)) AS tx FROM s)),
c AS (SELECT *, tx * 64 // tw AS x0, greatest(tx * 64 // tw + 1, ((tx + 1) * 64 + tw - 1) // tw) AS x1, ty * h // th AS y0, greatest(ty * h // th + 1, ((ty + 1) * h + th - 1) // th) AS y1 FROM t)
SELECT c.image_id, tx AS x, ty AS y, """ + ", ".join(f"CAST(round(round(avg({k}), 6)) AS BIGINT) AS {k}" for k in "rgba") + """
FROM c JOIN pixels p ON p.image_id = c.image_id AND p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1 GROUP BY c.image_id, tx, ty"""))
def tiled_resample(spark, sf):
    return tiled.tile_pixels(tiled.resample(_tiles(spark, sf), 20 + F.col("image_id") % 61, 30 + F.col("image_id") % 41))


@query(_case("""
SELECT image_id, round(sum(r) * 100.0::DOUBLE / (count(*) * 255.0::DOUBLE), 6) AS mean_alpha_pct, round(count_if(r >= 16) * 100.0::DOUBLE / count(*), 6) AS foreground_pct, bool_or(a < 255) AS transparent
FROM pixels GROUP BY image_id"""))
def tiled_mask_metrics(spark, sf):
    tiles = _tiles(spark, sf)
    metrics = tiled.mask_metrics(tiled.map_tiles(tiles, _channel(0)))
    return metrics.join(tiled.transparent_images(tiles), "image_id").select("image_id", rounded("mean_alpha_pct").alias("mean_alpha_pct"), rounded("foreground_pct").alias("foreground_pct"), "transparent")


@query(_case("""
, h AS (SELECT image_id, max(y) AS last FROM pixels GROUP BY image_id),
pts AS (SELECT * FROM (VALUES (0, 0.18, 0.21), (1, 0.33, 0.67), (2, 0.5, 0.5), (3, 0.72, 0.28), (4, 0.84, 0.79)) t(point, sx, sy))
SELECT image_id, CAST(point AS BIGINT) AS point, r AS first_r, """ + _level("r", "40") + """ AS second_r FROM pixels p JOIN h USING (image_id), pts
WHERE x = CAST(round(63 * sx::DOUBLE) AS BIGINT) AND y = CAST(round(last * sy::DOUBLE) AS BIGINT)"""))
def tiled_compare_samples(spark, sf):
    tiles = _tiles(spark, sf)
    samples = tiled.compare_samples(tiles, tiled.map_tiles(tiles, tiled.posterize, F.lit(40)))
    return samples.select("image_id", "point", F.col("a.r").alias("first_r"), F.col("b.r").alias("second_r"))


@query("WITH " + STRIPES_SQL.strip().removeprefix(",").replace("count_if(", "count(*) FILTER (WHERE ") + 'SELECT image_id, axis, start, "end" FROM bands')
def tiled_axis_bands(spark, sf):
    return tiled.axis_bands(_tiles(spark, sf, _striped)).select("image_id", "axis", "start", "end")


def _dark_range_sql() -> str:
    from assetflow.queries.base import REGISTRY

    return REGISTRY["dark_range"].sql


@query(_dark_range_sql())
def tiled_dark_range(spark, sf):
    tiles = _tiles(spark, sf, _striped)
    bands = tiled.axis_bands(tiles).withColumns({"sw": F.lit(192).cast("bigint"), "sh": F.col("height") * 2 + 5})
    return tiled.dark_range(tiles, bands, "sw", "sh").select("image_id", "axis", "start", "range_start", "range_end", "x", "y", "w", "h")


@query(_case("SELECT image_id, x, y, r, g, b, CASE WHEN image_id % 2 = 0 THEN a ELSE 255 END::BIGINT AS a FROM pixels"))
def read_bitmaps(spark, sf):
    """The rasters written as bitmap files of both depths and directions, and read again in tiles."""
    out = scratch_path(spark, "bitmaps")
    root = out if "://" in out or out.startswith("file:") else f"file://{out}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                px = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 4)
                with system.open_output_stream(f"{base}/{r['image_id']}.bmp") as f:
                    f.write(bitmap_bytes(px, 32 if r["image_id"] % 2 == 0 else 24, upward=r["image_id"] % 3 > 0))
            yield batch.select(["image_id"])

    files = _stacked(spark, sf, _mosaic).mapInArrow(write, "image_id bigint").withColumn("path", F.concat(F.lit(f"{root}/"), F.col("image_id").cast("string"), F.lit(".bmp")))
    listed = f"{out}-files"
    files.write.parquet(listed)
    tiles, _ = tiled.read_bitmaps(spark.read.parquet(listed), SIZE)
    return tiled.tile_pixels(tiles)


def bitmap_bytes(px: np.ndarray, depth: int, upward: bool = True) -> bytes:
    """An uncompressed bitmap file of an array of red, green, blue, alpha."""
    high, wide = px.shape[:2]
    stride = (wide * depth + 31) // 32 * 4
    rows = np.zeros((high, stride), np.uint8)
    rows[:, : wide * depth // 8] = px[..., [2, 1, 0, 3][: depth // 8]].reshape(high, -1)
    number = lambda v, n=4: int(v).to_bytes(n, "little", signed=True)
    head = b"BM" + number(54 + rows.size) + number(0) + number(54) + number(40) + number(wide) + number(high if upward else -high) + number(1, 2) + number(depth, 2)
    return reduce(bytes.__add__, [head, number(0), number(rows.size), bytes(16), (rows[::-1] if upward else rows).tobytes()])
