"""Rasters as tiles: rows of (image, tile row, tile column, packed bytes) of a bounded size, whatever the size of the image.

A tile has at most ``size`` x ``size`` pixels of one or four bytes; the tasks handle a tile as one array.  Rules of single pixels
map tiles and shuffle nothing.  Windows get their neighbourhood by an exchange of borders: each tile sends its neighbours only the rows
and columns they need.  Box means come from summed-area tables and the largest value of a window from running maxima, so the cost of a
pixel does not depend on the window.  Measures of whole images (shares, projections, reduced images) are partial sums of tiles that meet in
an aggregation; after it there are no pixels any more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.functions import raster as R
from assetflow.operators.pixels import SAMPLE_POINTS, map_ranges
from assetflow.session import ship_package

SIZE = 256
TILE = ["image_id", "width", "height", "size", "ty", "tx", "data"]
Row = dict[str, Any]


def _schema(df: DataFrame, names: list[str], **new: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, new[n]) if n in new else df.schema[n] for n in [*names, *[n for n in new if n not in names]]])


def _rows(batch: pa.RecordBatch) -> Iterator[Row]:
    """Rows with binary columns as views, not copies."""
    columns = [batch.column(i) for i in range(batch.num_columns)]
    for i in range(len(batch)):
        yield {n: c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py() for n, c in zip(batch.schema.names, columns)}


def _map(df: DataFrame, fn: Callable[[Row], Iterator[Row]], schema: T.StructType) -> DataFrame:
    """``fn`` on every row; results go out in batches of a few MB."""
    ship_package(df.sparkSession)
    kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in _rows(batch):
                for out in fn(row):
                    held.append(out)
                    size += 64 + sum(len(v) for v in out.values() if isinstance(v, bytes))
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)

    return df.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def extent(row: Row) -> tuple[int, int, int, int]:
    """``y0, y1, x0, x1`` of a tile in its image."""
    y0, x0 = row["ty"] * row["size"], row["tx"] * row["size"]
    return y0, min(y0 + row["size"], row["height"]), x0, min(x0 + row["size"], row["width"])


def pixels_of(row: Row, name: str = "data") -> np.ndarray:
    """The tile as an array of rows, columns and channels."""
    y0, y1, x0, x1 = extent(row)
    return np.frombuffer(row[name], np.uint8).reshape(y1 - y0, x1 - x0, -1)


# cutting and reading --------------------------------------------------------------


def _cut(row: Row, y0: int, px: np.ndarray) -> Iterator[Row]:
    """Tiles of whole rows of an image, from row ``y0`` on, which begins a tile."""
    size = row["size"]
    for y in range(0, len(px), size):
        for x in range(0, row["width"], size):
            yield {**{n: row[n] for n in TILE[:4]}, "ty": (y0 + y) // size, "tx": x // size, "data": px[y : y + size, x : x + size].tobytes()}


def cut_tiles(images: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of decoded images (``image_id, width, height, data``: packed channels, row by row)."""

    def cut(row: Row) -> Iterator[Row]:
        return _cut(row, 0, np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], -1))

    rows = images.select("image_id", F.col("width").cast("bigint"), F.col("height").cast("bigint"), F.lit(size).cast("bigint").alias("size"), "data")
    return _map(rows, cut, _schema(rows, TILE[:4], ty=T.LongType(), tx=T.LongType(), data=T.BinaryType()))


def read_bitmaps(files: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """``(tiles, failures)`` of uncompressed bitmaps (``image_id, path``) of 24 or 32 bits, as red, green, blue, alpha.

    Only the header is read per file; the rows of a file are then read in strips of a tile's height, by ranges of bytes and
    spread over the tasks, so no task holds an image.  Other files are told as failures."""

    def head(row: Row) -> Iterator[Row]:
        out: Row = {"image_id": row["image_id"], "path": row["path"], "reason": "not decodable"}
        try:
            system, path = fs.FileSystem.from_uri(row["path"])
            with system.open_input_file(path) as f:
                b, length = f.read(54), f.size()
        except (OSError, pa.ArrowInvalid) as e:
            yield out | {"reason": type(e).__name__}
            return
        number = lambda at, n=4: int.from_bytes(b[at : at + n], "little", signed=True)
        if len(b) == 54 and b[:2] == b"BM" and number(28, 2) in (24, 32) and number(30) in (0, 3) and number(18) > 0 and number(22):
            width, height, depth, start = number(18), abs(number(22)), number(28, 2), number(10)
            stride = (width * depth + 31) // 32 * 4
            if length >= start + stride * height:
                out |= {"reason": None, "width": width, "height": height, "depth": depth, "start": start, "stride": stride, "upward": number(22) > 0}
        yield out

    long_ = T.LongType()
    kinds = {"reason": T.StringType(), **dict.fromkeys(["width", "height", "depth", "start", "stride"], long_), "upward": T.BooleanType()}
    heads = _map(files.select("image_id", "path"), head, _schema(files, ["image_id", "path"], **kinds))
    strips = heads.filter("reason is null").withColumn("size", F.lit(size).cast("bigint"))
    strips = strips.withColumn("ty", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("height") / size) - 1))).repartition("image_id", "ty")

    def strip(row: Row) -> Iterator[Row]:
        y0, y1 = row["ty"] * size, min((row["ty"] + 1) * size, row["height"])
        first = row["height"] - y1 if row["upward"] else y0
        system, path = fs.FileSystem.from_uri(row["path"])
        with system.open_input_file(path) as f:
            raw = np.frombuffer(f.read_at((y1 - y0) * row["stride"], row["start"] + first * row["stride"]), np.uint8)
        raw = raw.reshape(y1 - y0, row["stride"])[:, : row["width"] * row["depth"] // 8].reshape(y1 - y0, row["width"], -1)
        px = np.full((y1 - y0, row["width"], 4), 255, np.uint8)
        px[..., :3] = (raw[::-1] if row["upward"] else raw)[..., 2::-1]
        if row["depth"] == 32:
            px[..., 3] = (raw[::-1] if row["upward"] else raw)[..., 3]
        yield from _cut(row, y0, px)

    tiles = _map(strips, strip, _schema(strips, ["image_id", "width", "height", "size"], ty=long_, tx=long_, data=T.BinaryType()))
    return tiles, heads.filter("reason is not null").select("image_id", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("file_name"), "reason")


def tile_pixels(tiles: DataFrame, fields: str | None = "rgba") -> DataFrame:
    """``image_id, x, y`` and the channels (or ``value``) of each pixel."""
    names = list(fields) if fields else ["value"]
    kinds = pa.schema([("image_id", _arrow(tiles.schema["image_id"].dataType)), *[(n, pa.int64()) for n in ["x", "y", *names]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                y0, y1, x0, x1 = extent(row)
                px = pixels_of(row)
                y, x = np.mgrid[y0:y1, x0:x1].reshape(2, -1)
                held = [pa.repeat(pa.scalar(row["image_id"], kinds[0].type), len(y)), pa.array(x), pa.array(y)]
                yield pa.RecordBatch.from_arrays([*held, *[pa.array(px[..., i].ravel().astype(np.int64)) for i in range(len(names))]], schema=kinds)

    ship_package(tiles.sparkSession)
    new = {n: T.LongType() for n in ["x", "y", *names]}
    return tiles.select(*TILE).mapInArrow(run, _schema(tiles, ["image_id"], **new))


# single pixels ------------------------------------------------------------------------
PixelRule = Callable[..., np.ndarray]


def map_tiles(tiles: DataFrame, rule: PixelRule, *args: Column, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """``rule(pixels, *others' pixels, *args)`` on each tile.  ``others`` are tiles of the same images cut alike; they meet by image and place."""
    rows = tiles.select(*TILE, *[a.alias(f"_a{i}") for i, a in enumerate(args)])
    for name, other in (others or {}).items():
        rows = rows.join(other.select("image_id", "ty", "tx", F.col("data").alias(f"_o_{name}")), ["image_id", "ty", "tx"])
    count, names = len(args), [f"_o_{n}" for n in others or {}]

    def run(row: Row) -> Iterator[Row]:
        out = rule(pixels_of(row), *[pixels_of(row, n) for n in names], *[row[f"_a{i}"] for i in range(count)])
        yield {**{n: row[n] for n in TILE}, "data": np.ascontiguousarray(out, np.uint8).tobytes()}

    return _map(rows, run, _schema(rows, TILE))


def whole(x: np.ndarray) -> np.ndarray:
    """Rounded half up after six decimals, within a byte."""
    return np.clip(np.floor(np.round(x, 6) + 0.5), 0, 255).astype(np.uint8)


def dark(px: np.ndarray) -> np.ndarray:
    luma = (px[..., :3].astype(np.int64) @ np.array([299, 587, 114])) // 1000
    return (px[..., 3] > R.DARK_ALPHA) & (luma < R.DARK_LUMA)


def posterize(px: np.ndarray, quality: int) -> np.ndarray:
    quality = min(max(quality, 1), 100)
    if quality >= 100:
        return px
    levels = next((n for least, n in ((90, 6), (70, 5), (50, 4), (30, 3)) if quality >= least), 2)
    step = 255.0 / (levels - 1)
    table = np.rint(np.clip(np.rint(np.arange(256) / step), 0, levels - 1) * step).astype(np.uint8)
    out = px.copy()
    out[..., :3] = np.where(px[..., 3:] == 0, px[..., :3], table[px[..., :3]])
    return out


def threshold_mask(px: np.ndarray) -> np.ndarray:
    return np.where((px[..., 3:] >= R.MASK_THRESHOLD) | (px[..., :1] >= R.MASK_THRESHOLD), 255, 0)


def apply_mask(px: np.ndarray, mask: np.ndarray) -> np.ndarray:
    out = px.copy()
    out[..., 3] = np.clip(np.floor(mask[..., 0] * (px[..., 3] / 255.0) + 0.5), 0, 255)
    return out


def composite(px: np.ndarray, *colour: int) -> np.ndarray:
    keep = px[..., 3:] / 255.0
    out = np.full_like(px, 255)
    out[..., :3] = whole(px[..., :3] * keep + np.array(colour) * (1 - keep))
    return out


def lerp_blend(source: np.ndarray, result: np.ndarray, mask: np.ndarray) -> np.ndarray:
    out, first = np.full_like(source, 255), source[..., :3].astype(float)
    out[..., :3] = whole(first + (result[..., :3] - first) * (mask / 255.0))
    return out


def soften(mask: np.ndarray, smooth: np.ndarray, strength: float) -> np.ndarray:
    weight = min(max(strength / 100.0, 0.0), 1.0) * R.EDGE_WEIGHT
    own, soft = mask / 255.0, smooth / 255.0
    return whole((own + (soft - own) * np.where((own > R.EDGE_LOW) & (own < R.EDGE_HIGH), weight, 0.0)) * 255.0)


# windows -----------------------------------------------------------------------------------


def _window(row: Row, n: int) -> tuple[int, int, int, int]:
    """The tile with what lies within ``n`` pixels of it, cut at the image's borders."""
    y0, y1, x0, x1 = extent(row)
    return max(y0 - n, 0), min(y1 + n, row["height"]), max(x0 - n, 0), min(x1 + n, row["width"])


def _patched(df: DataFrame, patches: Callable[[Row], Iterator[Row]], settle: Callable[[list[Row]], Row]) -> DataFrame:
    """``patches`` of each tile go to the tiles they name; ``settle`` makes each tile from its patches (with ``top, left, high, wide, patch``)."""
    place = {n: T.LongType() for n in ("top", "left", "high", "wide")}
    sent = _map(df, patches, _schema(df, TILE[:6], **place, patch=T.BinaryType()))
    kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in _schema(df, TILE)])

    def join(group: pa.Table) -> pa.Table:
        parts = [r for b in group.to_batches() for r in _rows(b)]
        return pa.Table.from_pylist([{**{n: parts[0][n] for n in TILE[:6]}, **settle(parts)}], kinds)

    return sent.groupBy("image_id", "ty", "tx").applyInArrow(join, _schema(df, TILE))


def window_tiles(tiles: DataFrame, n: int, rule: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """``rule(window, n)`` on each tile with its neighbourhood of ``n`` pixels; of the result the tile's own part is kept.  Tiles send
    each other the borders they need, over several tiles where ``n`` is larger than a tile."""

    def patches(row: Row) -> Iterator[Row]:
        px, (y0, y1, x0, x1), size = pixels_of(row), extent(row), row["size"]
        for ty in range(max(y0 - n, 0) // size, (min(y1 + n, row["height"]) - 1) // size + 1):
            for tx in range(max(x0 - n, 0) // size, (min(x1 + n, row["width"]) - 1) // size + 1):
                other = {**row, "ty": ty, "tx": tx}
                a, b, c, d = _window(other, n)
                a, b, c, d = max(a, y0), min(b, y1), max(c, x0), min(d, x1)
                part = px[a - y0 : b - y0, c - x0 : d - x0].tobytes()
                yield {**{k: other[k] for k in TILE[:6]}, "top": a, "left": c, "high": b - a, "wide": d - c, "patch": part}

    def settle(parts: list[Row]) -> Row:
        a, b, c, d = _window(parts[0], n)
        first = parts[0]
        channels = len(first["patch"]) // (first["high"] * first["wide"])
        window = np.zeros((b - a, d - c, channels), np.uint8)
        for p in parts:
            y, x = p["top"] - a, p["left"] - c
            window[y : y + p["high"], x : x + p["wide"]] = np.frombuffer(p["patch"], np.uint8).reshape(p["high"], p["wide"], -1)
        y0, y1, x0, x1 = extent(first)
        return {"data": np.ascontiguousarray(rule(window, n)[y0 - a : y1 - a, x0 - c : x1 - c], np.uint8).tobytes()}

    return _patched(tiles.select(*TILE), patches, settle)


def running_max(px: np.ndarray, n: int, axis: int) -> np.ndarray:
    """The largest value within ``n`` places along an axis: maxima from both ends of blocks as long as the window."""
    v = np.moveaxis(px, axis, 0)
    k, count = 2 * n + 1, len(v)
    blocks = -(-(count + 2 * n) // k)
    padded = np.zeros((blocks * k, *v.shape[1:]), v.dtype)
    padded[n : n + count] = v
    cut = padded.reshape(blocks, k, *v.shape[1:])
    ahead = np.maximum.accumulate(cut, 1).reshape(padded.shape)
    back = np.maximum.accumulate(cut[:, ::-1], 1)[:, ::-1].reshape(padded.shape)
    return np.moveaxis(np.maximum(back[:count], ahead[k - 1 : k - 1 + count]), 0, axis)


def grown(px: np.ndarray, n: int) -> np.ndarray:
    return np.where(running_max(running_max(px, n, 0), n, 1) >= R.MASK_THRESHOLD, 255, 0)


def box_means(px: np.ndarray, n: int) -> np.ndarray:
    """Means of the squares around each pixel, cut at the borders, from a summed-area table."""
    h, w = px.shape[:2]
    area = np.zeros((h + 1, w + 1, px.shape[2]), np.int64)
    area[1:, 1:] = px.astype(np.int64).cumsum(0).cumsum(1)
    y0, y1 = np.maximum(np.arange(h) - n, 0)[:, None], np.minimum(np.arange(h) + n + 1, h)[:, None]
    x0, x1 = np.maximum(np.arange(w) - n, 0)[None], np.minimum(np.arange(w) + n + 1, w)[None]
    total = area[y1, x1] - area[y0, x1] - area[y1, x0] + area[y0, x0]
    return whole(total / ((y1 - y0) * (x1 - x0))[..., None])


def dilate_mask(masks: DataFrame, n: int) -> DataFrame:
    """A mask (one byte a pixel) grown by a square of ``n`` pixels, then thresholded."""
    return window_tiles(masks, n, grown) if n > 0 else masks


def box_mean(tiles: DataFrame, n: int) -> DataFrame:
    return window_tiles(tiles, n, box_means)


def resample(tiles: DataFrame, target_width: Column, target_height: Column) -> DataFrame:
    """Area mean: a target pixel is the mean of the source pixels it covers (at least one).  A tile sends the sums of its own part of
    every target pixel that it touches."""
    rows = tiles.select(*TILE, target_width.cast("bigint").alias("_tw"), target_height.cast("bigint").alias("_th"))

    def covered(t: np.ndarray, source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
        low = t * source // target
        return low, np.maximum(low + 1, -(-(t + 1) * source // target))

    def touched(a: int, b: int, source: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Target places that cover a part of ``a .. b``, and where that part begins and ends."""
        t = np.arange(max(a * target // source - 1, 0), min(-(-b * target // source) + 1, target))
        low, high = covered(t, source, target)
        hit = (low < b) & (high > a)
        return t[hit], np.maximum(low[hit], a) - a, np.minimum(high[hit], b) - a

    def patches(row: Row) -> Iterator[Row]:
        px, (y0, y1, x0, x1), size = pixels_of(row), extent(row), row["size"]
        area = np.zeros((y1 - y0 + 1, x1 - x0 + 1, px.shape[2]), np.int64)
        area[1:, 1:] = px.astype(np.int64).cumsum(0).cumsum(1)
        ys, a, b = touched(y0, y1, row["height"], row["_th"])
        xs, c, d = touched(x0, x1, row["width"], row["_tw"])
        a, b, c, d = a[:, None], b[:, None], c[None], d[None]
        sums = area[b, d] - area[a, d] - area[b, c] + area[a, c]
        for ty in np.unique(ys // size).tolist():
            for tx in np.unique(xs // size).tolist():
                i, j = np.flatnonzero(ys // size == ty), np.flatnonzero(xs // size == tx)
                yield {
                    "image_id": row["image_id"], "width": row["_tw"], "height": row["_th"], "size": size, "ty": ty, "tx": tx, "top": int(ys[i[0]]),
                    "left": int(xs[j[0]]), "high": len(i), "wide": len(j), "patch": sums[i[0] : i[-1] + 1, j[0] : j[-1] + 1].tobytes(),
                    "_w": row["width"], "_h": row["height"],
                }

    place = {n: T.LongType() for n in ("top", "left", "high", "wide", "_w", "_h")}
    sent = _map(rows, patches, _schema(rows, TILE[:6], **place, patch=T.BinaryType()))
    schema = _schema(rows, TILE)
    kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])

    def join(group: pa.Table) -> pa.Table:
        first, total = None, None
        for batch in group.to_batches():
            for p in _rows(batch):
                if first is None:
                    first = p
                    y0, y1, x0, x1 = extent(p)
                    total = np.zeros((y1 - y0, x1 - x0, len(p["patch"]) // (8 * p["high"] * p["wide"])), np.int64)
                y, x = p["top"] - y0, p["left"] - x0
                total[y : y + p["high"], x : x + p["wide"]] += np.frombuffer(p["patch"], np.int64).reshape(p["high"], p["wide"], -1)
        a, b = covered(np.arange(y0, y1), first["_h"], first["height"])
        c, d = covered(np.arange(x0, x1), first["_w"], first["width"])
        mean = whole(total / ((b - a)[:, None] * (d - c)[None])[..., None])
        return pa.Table.from_pylist([{**{n: first[n] for n in TILE[:6]}, "data": mean.tobytes()}], kinds)

    return sent.groupBy("image_id", "ty", "tx").applyInArrow(join, schema)


# whole images -----------------------------------------------------------------------------------


def _partial(df: DataFrame, fn: Callable[[Row], dict[str, np.ndarray]], new: dict[str, T.DataType], keep: list[str]) -> DataFrame:
    """Rows of numbers from each tile, as columns of equal length; ``keep`` are repeated."""
    kinds = pa.schema([(n, _arrow(df.schema[n].dataType)) for n in keep] + [(n, _arrow(t)) for n, t in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                got = fn(row)
                n = len(next(iter(got.values())))
                held = [pa.repeat(pa.scalar(row[k], kinds.field(k).type), n) for k in keep]
                yield pa.RecordBatch.from_arrays([*held, *[pa.array(got[k], kinds.field(k).type) for k in new]], schema=kinds)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, _schema(df, keep, **new))


def mask_metrics(masks: DataFrame) -> DataFrame:
    """``image_id, mean_alpha_pct, foreground_pct`` of one-byte masks."""
    sums = lambda row: {"total": [int((px := pixels_of(row)).sum(dtype=np.int64))], "shown": [int((px >= R.MASK_THRESHOLD).sum())], "n": [px.size]}
    parts = _partial(masks.select(*TILE), sums, dict.fromkeys(["total", "shown", "n"], T.LongType()), ["image_id"])
    whole_ = parts.groupBy("image_id").agg(*[F.sum(c).alias(c) for c in ("total", "shown", "n")])
    share = lambda part, of: F.coalesce(F.try_divide(F.col(part) * F.lit(100.0), of), F.lit(0.0))
    return whole_.select("image_id", share("total", F.col("n") * F.lit(255.0)).alias("mean_alpha_pct"), share("shown", F.col("n")).alias("foreground_pct"))


def transparent_images(tiles: DataFrame) -> DataFrame:
    """``image_id, transparent``: whether any pixel is not opaque."""
    seen = lambda row: {"t": [bool((pixels_of(row)[..., 3] < 255).any())]}
    return _partial(tiles.select(*TILE), seen, {"t": T.BooleanType()}, ["image_id"]).groupBy("image_id").agg(F.bool_or("t").alias("transparent"))


def sample_pixels(tiles: DataFrame) -> DataFrame:
    """``image_id, point, label, p``: the pixels at the five fixed points.  Only they leave a tile."""
    points = []
    for n, (sx, sy) in enumerate(SAMPLE_POINTS):
        spot = lambda size, share: F.round((F.col(size) - 1) * F.lit(share)).cast("bigint")
        points.append(F.struct(F.lit(n).cast("bigint").alias("point"), F.lit(f"@{round(sx * 100)}%,{round(sy * 100)}%").alias("label"), spot("width", sx).alias("x"), spot("height", sy).alias("y")))
    held = lambda p: (F.floor(p["x"] / F.col("size")) == F.col("tx")) & (F.floor(p["y"] / F.col("size")) == F.col("ty"))
    rows = tiles.select("*", F.explode(F.filter(F.array(*points), held)).alias("s"))
    wide = F.least(F.col("size"), F.col("width") - F.col("tx") * F.col("size"))
    at = ((F.col("s.y") - F.col("ty") * F.col("size")) * wide + F.col("s.x") - F.col("tx") * F.col("size")) * 4
    byte = lambda i: F.conv(F.hex(F.substring("data", (at + 1 + i).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return rows.select("image_id", "s.point", "s.label", F.struct(*[byte(i).alias(c) for i, c in enumerate("rgba")]).alias("p"))


def compare_samples(first: DataFrame, second: DataFrame) -> DataFrame:
    """``image_id, point, label, a, b, delta`` at the five fixed points of two renditions."""
    a, b = sample_pixels(first).withColumnRenamed("p", "a"), sample_pixels(second).select("image_id", "point", F.col("p").alias("b"))
    delta = sum((F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "rgb"), F.lit(0).cast("bigint"))
    return a.join(b, ["image_id", "point"]).select("image_id", "point", "label", "a", "b", delta.alias("delta"))


def dark_profiles(tiles: DataFrame) -> DataFrame:
    """``image_id, width, height, axis, i, n``: dark pixels of every column and row that has any."""

    def count(row: Row) -> dict[str, np.ndarray]:
        d, (y0, _, x0, _) = dark(pixels_of(row)), extent(row)
        n = np.concatenate([d.sum(0), d.sum(1)])
        i = np.concatenate([x0 + np.arange(d.shape[1]), y0 + np.arange(d.shape[0])])
        axis = np.array(["column"] * d.shape[1] + ["row"] * d.shape[0])
        return {"axis": axis[n > 0], "i": i[n > 0], "n": n[n > 0]}

    keep, new = ["image_id", "width", "height"], {"axis": T.StringType(), "i": T.LongType(), "n": T.LongType()}
    return _partial(tiles.select(*TILE), count, new, keep).groupBy(*keep, "axis", "i").agg(F.sum("n").alias("n"))


def axis_bands(tiles: DataFrame) -> DataFrame:
    """``image_id, width, height, axis, start, end``: runs of columns and of rows that are dark enough, as islands of the profile (of an
    image's width and height)."""
    column = F.col("axis") == "column"
    length, other = F.when(column, F.col("width")).otherwise(F.col("height")), F.when(column, F.col("height")).otherwise(F.col("width"))
    active = dark_profiles(tiles).filter(F.col("n") >= F.greatest(F.lit(3), F.floor(other / 22)))
    keys = ["image_id", "width", "height", "axis"]
    island = F.col("i") - F.row_number().over(Window.partitionBy(*keys).orderBy("i"))
    runs = active.withColumn("_isle", island).groupBy(*keys, "_isle").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"))
    return runs.filter(F.col("end") - F.col("start") >= F.greatest(F.lit(12), F.floor(length / 14))).drop("_isle")


def dark_range(tiles: DataFrame, bands: DataFrame, source_width: str, source_height: str) -> DataFrame:
    """The dark extent of each band on the other axis, mapped with padding to a source rectangle.  A tile counts under the bands that
    cross it; bands carry no pixels."""
    lists = bands.groupBy("image_id").agg(F.collect_list(F.struct("axis", "start", "end")).alias("bands"))  # at most a twelfth of the image's edges

    def count(row: Row) -> dict[str, np.ndarray]:
        d, (y0, y1, x0, x1) = dark(pixels_of(row)), extent(row)
        out: dict[str, list] = {n: [] for n in ("axis", "start", "end", "i", "n")}
        for b in row["bands"]:
            low, high, across = (x0, x1, y0) if b["axis"] == "column" else (y0, y1, x0)
            a, z = max(b["start"], low) - low, min(b["end"], high) - low
            if a < z:
                n = d[:, a:z].sum(1) if b["axis"] == "column" else d[a:z].sum(0)
                for k in np.flatnonzero(n).tolist():
                    for name, v in zip(out, (b["axis"], b["start"], b["end"], across + k, int(n[k]))):
                        out[name].append(v)
        return out

    new = {"axis": T.StringType(), **dict.fromkeys(["start", "end", "i", "n"], T.LongType())}
    parts = _partial(tiles.select(*TILE).join(lists, "image_id"), count, new, ["image_id"])
    keys = ["image_id", "axis", "start", "end"]
    counts = parts.groupBy(*keys, "i").agg(F.sum("n").alias("n"))
    enough = F.greatest(F.lit(3), F.floor(F.greatest(F.col("end") - F.col("start"), F.lit(1)) / 18))
    found = counts.filter(F.col("n") >= enough).groupBy(*keys).agg(F.min("i").alias("range_start"), (F.max("i") + 1).alias("range_end"))
    return map_ranges(bands.join(found, keys), source_width, source_height)
