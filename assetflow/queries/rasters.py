"""Pixel and tensor operators (J, and C8, C9, D11, D12, E5, E6, E10, F5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from assetflow.fixtures import derive, duck, rasters, tensors
from assetflow.functions import content as C
from assetflow.functions import raster as R
from assetflow.operators import pixels as P
from assetflow.queries.base import query, rounded
from assetflow.session import table



def _quality():
    return (F.col("image_id") * 13) % 110


def _strength():
    return F.col("image_id") % 101


DARK_SQL = "a > 32 AND (r * 299 + g * 587 + b * 114) // 1000 < 205"


@query(duck("pixels", f"SELECT image_id, x, y, {DARK_SQL} AS value FROM pixels"))
def dark_pixels(spark, sf):
    return P.pixel_rows(rasters(spark, sf).withColumn("dark", R.dark_pixels("px")), "dark", None)


def _level(c: str, q: str = "(image_id * 13) % 110") -> str:
    lv = f"(CASE WHEN greatest({q}, 1) >= 90 THEN 6 WHEN {q} >= 70 THEN 5 WHEN {q} >= 50 THEN 4 WHEN {q} >= 30 THEN 3 ELSE 2 END)"
    step = f"(255.0::DOUBLE / ({lv} - 1))"
    return (
        f"CASE WHEN a = 0 OR {q} >= 100 THEN {c} ELSE CAST(round_even(least(greatest(round_even({c} / {step}, 0), 0), {lv} - 1) * {step}, 0) AS BIGINT) END"
    )


@query(duck("pixels", f"SELECT image_id, x, y, {_level('r')} AS r, {_level('g')} AS g, {_level('b')} AS b, CAST(a AS BIGINT) AS a FROM pixels"))
def posterize(spark, sf):
    return P.pixel_rows(rasters(spark, sf).withColumn("px", R.posterize("px", _quality())), "px")


@query(duck("pixels", "SELECT image_id, count_if(a >= 16 OR r >= 16) AS masked, bool_or(a >= 16 OR r >= 16) AS has_mask FROM pixels GROUP BY image_id"))
def threshold_mask(spark, sf):
    masks = rasters(spark, sf).withColumn("mask", R.threshold_mask("px"))
    return masks.select(
        "image_id", F.size(F.filter("mask", lambda v: v == 255)).cast("bigint").alias("masked"), R.has_mask("mask").alias("has_mask")
    )


MODEL_NAMES = list(R.MATTING_MODELS)


def _model_case(kind: int, i: int) -> str:
    return "CASE image_id % 4 " + " ".join(
        f"WHEN {n} THEN {R.MATTING_MODELS[m][kind][i]}::DOUBLE" for n, m in enumerate(MODEL_NAMES)
    ) + " END"


@query(duck("pixels", "SELECT image_id, x, y, " + ", ".join(
    f"round(({c} / 255.0::DOUBLE - {_model_case(3, i)}) / {_model_case(4, i)}, 6) AS {c}" for i, c in enumerate("rgb")
) + " FROM pixels"))
def tensor_normalize(spark, sf):
    def per_model(kind: int, i: int):
        cases = [(F.col("image_id") % 4 == n, F.lit(R.MATTING_MODELS[m][kind][i])) for n, m in enumerate(MODEL_NAMES)]
        return reduce(lambda acc, c: acc.when(*c), cases[1:], F.when(*cases[0]))

    mean, std = [per_model(3, i) for i in range(3)], [per_model(4, i) for i in range(3)]
    normalized = F.transform(
        R.tensor_normalize("px", mean, std),
        lambda v: F.struct(*[F.round(F.get(v, F.lit(i)), 6).alias(c) for i, c in enumerate("rgb")]),
    )
    return P.pixel_rows(rasters(spark, sf).withColumn("v", normalized), "v", "rgb")


@query(duck("pixels", "SELECT image_id, x, y, least(greatest(CAST(round(g * (a / 255.0::DOUBLE)) AS BIGINT), 0), 255) AS a FROM pixels"))
def apply_mask(spark, sf):
    masked = rasters(spark, sf).withColumn("px", R.apply_mask("px", F.transform("px", lambda p: p["g"])))
    return P.pixel_rows(masked, "px", "a")


BLUR_SQL = """
, blur AS (SELECT p.image_id, p.x, p.y, any_value(p.r) AS m, CAST(round(round(avg(n.r), 6)) AS BIGINT) AS s FROM pixels p JOIN pixels n ON n.image_id = p.image_id AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1 GROUP BY p.image_id, p.x, p.y)
"""


def _blurred(spark, sf):
    masks = rasters(spark, sf).withColumn("mask", F.transform("px", lambda p: p["r"]))
    return P.box_mean(masks, "mask", 1, "smooth")


@query(duck("pixels", BLUR_SQL + """
SELECT image_id, x, y, least(greatest(CAST(round(round((m / 255.0::DOUBLE + (s / 255.0::DOUBLE - m / 255.0::DOUBLE) * CASE WHEN m / 255.0::DOUBLE > 0.03 AND m / 255.0::DOUBLE < 0.97 THEN 0.75::DOUBLE * (image_id % 101) / 100 ELSE 0 END) * 255, 6)) AS BIGINT), 0), 255) AS value FROM blur"""))
def soften_edges(spark, sf):
    return P.pixel_rows(_blurred(spark, sf).withColumn("v", R.soften("mask", "smooth", _strength())), "v", None)


BLEND_SQL = BLUR_SQL + """
, mixd AS (SELECT *, 0.18::DOUBLE + (image_id % 101) / 100.0::DOUBLE * 0.36::DOUBLE AS mix FROM blur),
bm AS (SELECT image_id, x, y, CASE WHEN image_id % 101 <= 0 THEN m ELSE least(greatest(CAST(round(round(least(greatest(m / 255.0::DOUBLE * (1 - mix) + s / 255.0::DOUBLE * mix, 0), 1) * 255, 6)) AS BIGINT), 0), 255) END AS k FROM mixd),
po AS (SELECT image_id, x, y, r, g, b, """ + ", ".join(f"{_level(c, '40')} AS {c}2" for c in "rgb") + """ FROM pixels)
"""


@query(duck("pixels", BLEND_SQL + "SELECT po.image_id, po.x, po.y, " + ", ".join(
    f"least(greatest(CAST(round(round({c} + ({c}2 - {c}) * (k / 255.0::DOUBLE), 6)) AS BIGINT), 0), 255) AS {c}" for c in "rgb"
) + " FROM po JOIN bm ON po.image_id = bm.image_id AND po.x = bm.x AND po.y = bm.y"))
def lerp_blend(spark, sf):
    blurred = _blurred(spark, sf)
    masks = blurred.select("image_id", R.blend_mask("mask", "smooth", _strength()).alias("mask"))
    source = rasters(spark, sf)
    result = source.withColumn("px", R.posterize("px", F.lit(40)))
    joined = P.blend_join(source, result, masks)
    return P.pixel_rows(joined.withColumn("px", R.lerp_blend("source_px", "result_px", "mask")), "px", "rgb")


@query(duck("pixels", """
SELECT p.image_id, p.x, p.y, p.r AS source_r, """ + _level("r", "40") + """ AS result_r, p.g AS mask FROM pixels p"""))
def blend_join(spark, sf):
    source = rasters(spark, sf)
    result = source.withColumn("px", R.posterize("px", F.lit(40)))
    mask = source.select("image_id", F.transform("px", lambda p: p["g"]).alias("mask"))
    joined = P.blend_join(source, result, mask)
    cells = F.zip_with(
        F.zip_with("source_px", "result_px", lambda s, r: F.struct(s["r"].alias("source_r"), r["r"].alias("result_r"))),
        "mask", lambda c, m: F.struct(c["source_r"].alias("source_r"), c["result_r"].alias("result_r"), m.alias("mask")),
    )
    return P.pixel_rows(joined.withColumn("c", cells), "c", ["source_r", "result_r", "mask"])


@query(duck("pixels", "SELECT image_id, x, y, " + ", ".join(
    f"least(greatest(CAST(round(round({c} * (a / 255.0::DOUBLE) + bg{c} * (1 - a / 255.0::DOUBLE), 6)) AS BIGINT), 0), 255) AS {c}" for c in "rgb"
) + ", CAST(255 AS BIGINT) AS a FROM (SELECT *, CASE WHEN image_id % 3 = 0 THEN 255 ELSE 16 END AS bgr, CASE WHEN image_id % 3 = 0 THEN 255 ELSE 32 END AS bgg, CASE WHEN image_id % 3 = 0 THEN 255 ELSE 171 END AS bgb FROM pixels)"))
def composite_background(spark, sf):
    colour = R.argb_channels(F.when(F.col("image_id") % 3 == 0, "white").otherwise("#FF1020AB"))
    images = rasters(spark, sf).withColumns(dict(zip(("_r", "_g", "_b"), colour, strict=True)))
    return P.pixel_rows(images.withColumn("px", R.composite_background("px", (F.col("_r"), F.col("_g"), F.col("_b")))), "px")


RESAMPLE_SQL = """
, t AS (SELECT image_id, tw, th, tx, unnest(range(0, th)) AS ty FROM (SELECT image_id, 3 + image_id % 11 AS tw, 2 + image_id % 7 AS th, unnest(range(0, 3 + image_id % 11)) AS tx FROM (SELECT DISTINCT image_id FROM pixels))),
c AS (SELECT *, tx * 8 // tw AS x0, greatest(tx * 8 // tw + 1, ((tx + 1) * 8 + tw - 1) // tw) AS x1, ty * 8 // th AS y0, greatest(ty * 8 // th + 1, ((ty + 1) * 8 + th - 1) // th) AS y1 FROM t)
SELECT c.image_id, tx AS x, ty AS y, """ + ", ".join(f"CAST(round(round(avg({k}), 6)) AS BIGINT) AS {k}" for k in "rgba") + """
FROM c JOIN pixels p ON p.image_id = c.image_id AND p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1 GROUP BY c.image_id, tx, ty"""


@query(duck("pixels", RESAMPLE_SQL))
def resample(spark, sf):
    sized = rasters(spark, sf).withColumns({"tw": 3 + F.col("image_id") % 11, "th": 2 + F.col("image_id") % 7})
    return P.pixel_rows(P.resample(sized, "tw", "th"), "px")


@query(duck("", """
d AS (SELECT vec_id AS image_id, vec_id % 50 AS k, vec_id % 8 AS t FROM embeddings),
s AS (SELECT image_id, CASE t WHEN 0 THEN {'w': 300, 'h': 320 + k, 'l': 'nchw'} WHEN 1 THEN {'w': 48, 'h': 64 + k, 'l': 'nhwc'} WHEN 2 THEN {'w': 30, 'h': 40 + k, 'l': 'chw'}
   WHEN 3 THEN {'w': 20, 'h': 30 + k, 'l': 'hwc'} WHEN 4 THEN {'w': 60, 'h': 50 + k, 'l': 'bhw'} WHEN 5 THEN {'w': 70, 'h': 90 + k, 'l': 'hw'} END AS a, {'w': 64, 'h': 64, 'l': 'hw'} AS b FROM d)
SELECT image_id, CAST(p.w AS BIGINT) AS width, CAST(p.h AS BIGINT) AS height, p.l AS layout FROM (SELECT image_id, CASE WHEN a IS NULL OR a.w * a.h < b.w * b.h THEN b ELSE a END AS p FROM s)"""))
def tensor_shape(spark, sf):
    k, t = F.col("image_id") % 50, F.col("image_id") % 8
    dims = lambda *v: F.array(*[(x if not isinstance(x, int) else F.lit(x)).cast("int") for x in v])
    shapes = [
        dims(1, 1, 320 + k, 300), dims(1, 64 + k, 48, 3), dims(1, 40 + k, 30), dims(30 + k, 20, 2), dims(7, 50 + k, 60),
        dims(90 + k, 70), dims(5),
    ]
    chosen = reduce(lambda acc, p: acc.when(t == p[0], p[1]), list(enumerate(shapes))[1:], F.when(t == 0, shapes[0]))
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id")).withColumn(
        "dims", chosen.otherwise(dims(1, 9, 9, 9))
    )
    best = R.largest_candidate(F.array(R.tensor_shape(F.col("dims")), R.tensor_shape(dims(64, 64))))
    return rows.withColumn("s", best).select("image_id", "s.width", "s.height", "s.layout")


@query(duck("pixels", """
, v AS (SELECT image_id, x, y, CASE WHEN image_id % 3 = 0 THEN (v + 1) / 2 ELSE v * 300 END AS t FROM pixels),
s AS (SELECT *, CASE WHEN min(t) OVER (PARTITION BY image_id) >= 0 AND max(t) OVER (PARTITION BY image_id) <= 1 THEN 255 ELSE 1 END AS k FROM v)
SELECT image_id, x, y, least(greatest(CAST(round(round(t * k, 6)) AS BIGINT), 0), 255) AS value FROM s"""))
def descale_tensor(spark, sf):
    scaled = tensors(spark, sf).withColumn(
        "v", F.when(F.col("image_id") % 3 == 0, F.transform("v", lambda x: (x + 1) / 2)).otherwise(F.transform("v", lambda x: x * 300))
    )
    return P.pixel_rows(scaled.withColumn("width", F.lit(8)).withColumn("v", R.descale("v")), "v", None)


@query(duck("pixels", """
, v AS (SELECT image_id, x, y, CASE image_id % 3 WHEN 0 THEN (v + 1) / 2 WHEN 1 THEN v ELSE 5.0::DOUBLE END AS t FROM pixels),
s AS (SELECT *, min(t) OVER (PARTITION BY image_id) AS lo, max(t) OVER (PARTITION BY image_id) AS hi FROM v)
SELECT image_id, x, y, round(CASE WHEN lo >= 0 AND hi <= 1 THEN t WHEN hi - lo < 1e-6 THEN least(greatest(t, 0), 1) ELSE least(greatest((t - lo) / (hi - lo), 0), 1) END, 6) AS value FROM s"""))
def minmax_normalize(spark, sf):
    i = F.col("image_id") % 3
    shaped = tensors(spark, sf).withColumn(
        "v", F.when(i == 0, F.transform("v", lambda x: (x + 1) / 2)).when(i == 1, F.col("v")).otherwise(F.transform("v", lambda x: F.lit(5.0)))
    )
    values = F.transform(R.minmax_normalize("v"), lambda x: F.round(x, 6))
    return P.pixel_rows(shaped.withColumn("width", F.lit(8)).withColumn("v", values), "v", None)


@query(duck("pixels", """
SELECT image_id, round(sum(r) * 100.0::DOUBLE / (count(*) * 255.0::DOUBLE), 6) AS mean_alpha_pct, round(count_if(r >= 16) * 100.0::DOUBLE / count(*), 6) AS foreground_pct, round(count_if(a >= 16) * 100.0::DOUBLE / count(*), 6) AS coverage_pct
FROM pixels GROUP BY image_id"""))
def mask_metrics(spark, sf):
    red = R.mask_metrics(F.transform("px", lambda p: p["r"]))
    alpha = R.mask_metrics(F.transform("px", lambda p: p["a"]))
    return rasters(spark, sf).select(
        "image_id", *[rounded(c).alias(n) for n, c in red.items()], rounded(alpha["foreground_pct"]).alias("coverage_pct")
    )


SAMPLES_SQL = """
, pts AS (SELECT * FROM (VALUES (0, 18, 21, 1, 1), (1, 33, 67, 2, 5), (2, 50, 50, 4, 4), (3, 72, 28, 5, 2), (4, 84, 79, 6, 6)) t(point, px, py, sx, sy)),
po AS (SELECT image_id, x, y, r, g, b, """ + ", ".join(f"{_level(c)} AS {c}2" for c in "rgb") + """ FROM pixels),
sm AS (SELECT image_id, CAST(point AS BIGINT) AS point, px, py, r, g, b, r2, g2, b2, abs(r - r2) + abs(g - g2) + abs(b - b2) AS delta FROM po JOIN pts ON x = sx AND y = sy)
"""


def _samples(spark, sf):
    source = rasters(spark, sf)
    return P.compare_samples(source, source.withColumn("px", R.posterize("px", _quality())))


@query(duck("pixels", SAMPLES_SQL + "SELECT image_id, point, r AS first_r, r2 AS second_r, delta FROM sm"))
def compare_samples(spark, sf):
    return _samples(spark, sf).select("image_id", "point", F.col("a.r").alias("first_r"), F.col("b.r").alias("second_r"), "delta")


@query(duck("pixels", SAMPLES_SQL + """
SELECT image_id, point, delta, '@' || px || '%,' || py || '% RGB (' || r || ',' || g || ',' || b || ') -> (' || r2 || ',' || g2 || ',' || b2 || '), delta=' || delta AS summary
FROM sm QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY delta DESC, point) = 1"""))
def best_sample(spark, sf):
    return P.best_sample(_samples(spark, sf))


@query(duck("pixels", """
SELECT p.image_id, p.x, p.y, CASE WHEN max(CASE WHEN n.a >= 16 AND n.r > 140 THEN 255 ELSE 0 END) >= 16 THEN 255 ELSE 0 END::BIGINT AS value
FROM pixels p JOIN pixels n ON n.image_id = p.image_id AND abs(n.x - p.x) <= 2 AND abs(n.y - p.y) <= 2 GROUP BY p.image_id, p.x, p.y"""))
def dilate_mask(spark, sf):
    mask = F.transform("px", lambda p: F.when((p["a"] >= 16) & (p["r"] > 140), 255).otherwise(0).cast("bigint"))
    return P.pixel_rows(P.dilate_mask(rasters(spark, sf).withColumn("mask", mask), 2), "mask", None)


@query(duck("assets pixels", """
, seen AS (SELECT image_id, bool_or(a < 255) AS s FROM pixels GROUP BY 1)
SELECT asset_id, CASE WHEN lower(ext) = '.svg' THEN TRUE WHEN lower(ext) IN ('.jpg','.jpeg','.bmp') THEN FALSE WHEN lower(ext) = '.tif' THEN FALSE ELSE coalesce(s, FALSE) END AS has_transparency
FROM assets LEFT JOIN seen ON asset_id = image_id"""))
def transparency(spark, sf):
    known = F.lower("ext") == ".tif"
    return C.transparency(derive(spark, sf, "assets"), rasters(spark, sf), known).select("asset_id", "has_transparency")


# 64 embeddings in a row make one 64 x 64 image with dark stripes where values are positive
STRIPES_SQL = """
, big AS (SELECT vec_id // 64 AS image_id, (i - 1) AS x, vec_id % 64 AS y, ((vec_id % 64) // 16) % 2 = 0 AND ((i - 1) // 20) % 2 = 0 AND embedding[i] > 0 AS dark FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)),
sz AS (SELECT image_id, max(y) + 1 AS h FROM big GROUP BY 1),
ct AS (SELECT 'column' AS axis, big.image_id, x AS i, count_if(dark) AS n, any_value(h) AS other, 64 AS len FROM big JOIN sz ON sz.image_id = big.image_id GROUP BY 2, 3
  UNION ALL SELECT 'row', big.image_id, y, count_if(dark), 64, any_value(h) FROM big JOIN sz ON sz.image_id = big.image_id GROUP BY 2, 3),
ac AS (SELECT *, i - row_number() OVER (PARTITION BY axis, image_id ORDER BY i) AS isl FROM ct WHERE n >= greatest(3, other // 22)),
bands AS (SELECT image_id, axis, min(i) AS start, max(i) + 1 AS "end" FROM ac GROUP BY image_id, axis, isl HAVING count(*) >= greatest(12, any_value(len) // 14))
"""


def _stripes(spark, sf):
    """Square rasters stacked from 64 vectors each; a raster has at most 64 rows."""
    rows = table(spark, sf, "embeddings").select(
        F.expr("vec_id div 64").alias("image_id"), (F.col("vec_id") % 64).alias("y"), "embedding"
    )
    stacked = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "embedding"))).alias("rows"))
    white, black = [F.struct(*[F.lit(v).cast("bigint").alias(c) for c in "rgb"], F.lit(255).cast("bigint").alias("a")) for v in (250, 40)]
    dark_at = lambda v, x, y: (F.floor(y / 16) % 2 == 0) & (F.floor(x / 20) % 2 == 0) & (v > 0)
    px = F.flatten(F.transform("rows", lambda r: F.transform(
        r["embedding"], lambda v, x: F.when(dark_at(v, x, r["y"]), black).otherwise(white)
    )))
    return stacked.select(
        "image_id", F.lit(64).cast("bigint").alias("width"), F.size("rows").cast("bigint").alias("height"), px.alias("px")
    )


@query(duck("", STRIPES_SQL.strip().removeprefix(",") + 'SELECT image_id, axis, start, "end" FROM bands'))
def axis_bands(spark, sf):
    return P.axis_bands(_stripes(spark, sf)).select("image_id", "axis", "start", "end")


@query(duck("", STRIPES_SQL.strip().removeprefix(",") + """
, cnt AS (SELECT b.image_id, b.axis, b.start, b."end", CASE b.axis WHEN 'column' THEN y ELSE x END AS i, count_if(dark) AS n FROM bands b JOIN big p ON p.image_id = b.image_id AND CASE b.axis WHEN 'column' THEN x ELSE y END >= b.start AND CASE b.axis WHEN 'column' THEN x ELSE y END < b."end" GROUP BY 1, 2, 3, 4, 5),
rg AS (SELECT image_id, axis, start, "end", min(i) AS lo, max(i) + 1 AS hi FROM cnt WHERE n >= greatest(3, greatest("end" - start, 1) // 18) GROUP BY 1, 2, 3, 4),
q AS (SELECT rg.*, CASE axis WHEN 'column' THEN start ELSE lo END AS l, CASE axis WHEN 'column' THEN "end" ELSE hi END AS r, CASE axis WHEN 'column' THEN lo ELSE start END AS t, CASE axis WHEN 'column' THEN hi ELSE "end" END AS b,
   192 / 64.0::DOUBLE AS sx, CAST(h * 2 + 5 AS DOUBLE) / h AS sy, h FROM rg JOIN sz ON sz.image_id = rg.image_id),
e AS (SELECT *, greatest(14, CAST(round_even(sx * 10, 0) AS BIGINT)) AS px, greatest(14, CAST(round_even(sy * 10, 0) AS BIGINT)) AS py FROM q),
z AS (SELECT *, greatest(0, CAST(floor(l * sx) AS BIGINT) - px) AS x0, least(192, CAST(ceil(r * sx) AS BIGINT) + px) AS x1, greatest(0, CAST(floor(t * sy) AS BIGINT) - py) AS y0, least(h * 2 + 5, CAST(ceil(b * sy) AS BIGINT) + py) AS y1 FROM e)
SELECT image_id, axis, start, lo AS range_start, hi AS range_end, x0 AS x, y0 AS y, greatest(1, x1 - x0) AS w, greatest(1, y1 - y0) AS h FROM z"""))
def dark_range(spark, sf):
    bands = P.axis_bands(_stripes(spark, sf)).withColumns({
        "sw": F.lit(192).cast("bigint"), "sh": F.col("height") * 2 + 5,
    })
    return P.dark_range(bands, "sw", "sh").select("image_id", "axis", "start", "range_start", "range_end", "x", "y", "w", "h")
