"""Rasters in tiles against whole arrays."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetflow.operators import tiled
from assetflow.queries import tiles as tile_queries
from assetflow.queries.tiles import bitmap_bytes

FIELDS = "image_id long, width long, height long, data binary"


def images(spark, arrays):
    return spark.createDataFrame([(i, a.shape[1], a.shape[0], bytearray(a.tobytes())) for i, a in enumerate(arrays)], FIELDS)


def joined(tiles):
    """Tiles put together again: image -> array."""
    out = {}
    for r in tiles.collect():
        row = r.asDict()
        y0, y1, x0, x1 = tiled.extent(row)
        px = tiled.pixels_of(row)
        whole = out.setdefault(row["image_id"], np.zeros((row["height"], row["width"], px.shape[2]), np.uint8))
        whole[y0:y1, x0:x1] = px
    return out


def brute_window(a, n, fold):
    h, w = a.shape[:2]
    return np.array([[fold(a[max(y - n, 0) : y + n + 1, max(x - n, 0) : x + n + 1]) for x in range(w)] for y in range(h)])


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(4)
    return [rng.integers(0, 256, (h, w, 4), dtype=np.uint8) for h, w in ((1, 1), (7, 30), (23, 17), (16, 16), (3, 40))]


def test_cut_and_joined(spark, arrays):
    tiles = tiled.cut_tiles(images(spark, arrays), 8)
    assert max(len(r.data) for r in tiles.select("data").collect()) <= 8 * 8 * 4
    assert all((got == a).all() for got, a in zip((v for _, v in sorted(joined(tiles).items())), arrays))
    assert tiled.cut_tiles(images(spark, arrays).limit(0), 8).count() == 0


@pytest.mark.parametrize("n", [1, 5, 8, 19])  # below, beside and beyond a tile of 8
def test_windows_over_tile_borders(spark, arrays, n):
    masks = tiled.map_tiles(tiled.cut_tiles(images(spark, arrays), 8), lambda px: px[..., :1])
    spread, means = joined(tiled.dilate_mask(masks, n)), joined(tiled.box_mean(masks, n))
    for i, a in enumerate(arrays):
        m = a[..., 0].astype(np.int64)
        assert (spread[i][..., 0] == np.where(brute_window(m, n, np.max) >= 16, 255, 0)).all()
        assert (means[i][..., 0] == np.floor(np.round(brute_window(m, n, np.mean), 6) + 0.5)).all()


def test_resample_over_tiles(spark, arrays):
    for tw, th in ((5, 3), (50, 41), (16, 16)):
        got = joined(tiled.resample(tiled.cut_tiles(images(spark, arrays), 8), F.lit(tw), F.lit(th)))
        for i, a in enumerate(arrays):
            h, w = a.shape[:2]
            for y in range(th):
                for x in range(tw):
                    y0, x0 = y * h // th, x * w // tw
                    block = a[y0 : max(y0 + 1, -(-(y + 1) * h // th)), x0 : max(x0 + 1, -(-(x + 1) * w // tw))].reshape(-1, 4)
                    assert (got[i][y, x] == np.floor(np.round(block.mean(0), 6) + 0.5)).all()


def test_bitmaps_that_cannot_be_read(spark, tmp_path, arrays):
    (tmp_path / "good.bmp").write_bytes(bitmap_bytes(arrays[1], 24))
    (tmp_path / "short.bmp").write_bytes(bitmap_bytes(arrays[1], 24)[:-1])
    (tmp_path / "text.bmp").write_bytes(b"text")
    (tmp_path / "deep.bmp").write_bytes(bitmap_bytes(arrays[1], 32)[:28] + b"\x10" + bitmap_bytes(arrays[1], 32)[29:])
    names = ["good", "short", "text", "deep", "gone"]
    files = spark.createDataFrame([(i, f"file://{tmp_path}/{n}.bmp") for i, n in enumerate(names)], "image_id long, path string")
    tiles, failures = tiled.read_bitmaps(files, 8)
    got = joined(tiles)
    assert list(got) == [0] and (got[0][..., :3] == arrays[1][..., :3]).all() and (got[0][..., 3] == 255).all()
    assert sorted((r.image_id, r.file_name) for r in failures.collect()) == [(i, f"{names[i]}.bmp") for i in range(1, 5)]


def test_fifty_megapixels(spark, tmp_path):
    """An image no row of which is larger than a tile."""
    h, w = 6144, 8192
    rng = np.random.default_rng(9)
    px = np.full((h, w, 4), 250, np.uint8)
    px[..., 3] = 255
    px[1000:2500, 3000:5000, :3] = 40
    ys, xs = rng.integers(0, h, 300), rng.integers(0, w, 300)
    px[ys, xs, :3] = 10
    (tmp_path / "big.bmp").write_bytes(bitmap_bytes(px, 24))
    files = spark.createDataFrame([(1, f"file://{tmp_path}/big.bmp")], "image_id long, path string")
    tiles, failures = tiled.read_bitmaps(files)
    assert failures.count() == 0
    size = tiles.agg(F.max(F.length("data")).alias("m"), F.count(F.lit(1)).alias("n")).first()
    assert (size.m, size.n) == (256 * 256 * 4, 24 * 32)
    masks = tiled.map_tiles(tiles, lambda p: np.where(p[..., :1] < 16, 255, 0))
    grown = tiled.mask_metrics(tiled.dilate_mask(masks, 40)).first()
    want = np.zeros((h, w), bool)
    for y, x in zip(ys, xs):
        want[max(y - 40, 0) : y + 41, max(x - 40, 0) : x + 41] = True
    assert grown.foreground_pct == pytest.approx(want.mean() * 100)
    assert sorted((r.axis, r.start, r.end) for r in tiled.axis_bands(tiles).collect()) == [("column", 3000, 5000), ("row", 1000, 2500)]
    small = joined(tiled.resample(tiles, F.lit(8), F.lit(6)))[1]
    blocks = px.reshape(6, 1024, 8, 1024, 4).mean((1, 3))
    assert (small == np.floor(np.round(blocks, 6) + 0.5)).all()


def test_painting_holds_few_lines_at_once():
    rng = np.random.default_rng(1)
    v = rng.uniform(-1, 1, (20_000, 64)).astype(np.float32)
    held = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 64).cast(pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(20_000) // 64), pa.array(np.arange(20_000) % 64), held], names=["image_id", "y", "v"])
    tracemalloc.start()
    lines = 0
    for out in tile_queries._painter(tile_queries._mosaic)(iter([batch])):
        lines += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    first = np.frombuffer(next(tile_queries._painter(tile_queries._mosaic)(iter([batch]))).column("line")[7].as_py(), np.uint8).reshape(64, 4)
    assert lines == 20_000 and peak < 16 << 20
    assert first[:, 0].tolist() == np.floor((v[7].astype(float) + 1) * 127).astype(int).tolist()
