"""Size, depth and colour of images from the fixed offsets of their headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.operators.pixels import bind

# Leading bytes of the recognised containers (hexadecimal).
MAGIC = {"png": "89504E470D0A1A0A", "gif": "47494638", "bmp": "424D", "psd": "38425053", "ico": "00000100"}

# Colour modes and colour channel counts of layered documents; PNG colour types.
PSD_MODES = {
    0: ("Bitmap", 1), 1: ("Grayscale", 1), 2: ("Indexed", 1), 3: ("RGB", 3), 4: ("CMYK", 4),
    7: ("Multichannel", None), 8: ("Duotone", 1), 9: ("Lab", 3),
}
PNG_TYPES = {0: ("Grayscale", 1), 2: ("RGB", 3), 3: ("Indexed", 1), 4: ("Grayscale", 2), 6: ("RGBA", 4)}


def big_endian(head: Column, at: int, n: int) -> Column:
    """Unsigned integer of ``n`` bytes from the one-based byte ``at`` of a hex text."""
    return F.conv(F.substring(head, 2 * at - 1, 2 * n), 16, 10).cast("bigint")


def little_endian(head: Column, at: int, n: int) -> Column:
    text = F.concat(*[F.substring(head, 2 * (at + i) - 1, 2) for i in reversed(range(n))])
    return F.conv(text, 16, 10).cast("bigint")


def _pick(code: Column, values: dict[int, object], kind: str) -> Column:
    branches = [(code == k, F.lit(v).cast(kind)) for k, v in values.items()]
    return reduce(lambda acc, b: acc.when(*b), branches[1:], F.when(*branches[0]))


def _kind(head: Column) -> Column:
    """Container by its leading bytes, where its fixed fields are all present."""
    least = {"ico": 8, "gif": 10}
    tests = [
        (F.startswith(head, F.lit(magic)) & (F.length(head) >= 2 * least.get(name, 26)), name)
        for name, magic in MAGIC.items()
    ]
    return reduce(lambda acc, t: acc.when(*t), tests[1:], F.when(*tests[0]))


def _fields(c: Column, k: Column) -> Column:
    ico_edge = lambda at: F.when(little_endian(c, at, 1) == 0, 256).otherwise(little_endian(c, at, 1))
    psd_mode, png_type = big_endian(c, 25, 2), big_endian(c, 26, 1)
    signed = lambda v: F.abs(F.when(v >= 2**31, v - 2**32).otherwise(v))
    width = (
        F.when(k == "png", big_endian(c, 17, 4)).when(k == "gif", little_endian(c, 7, 2))
        .when(k == "bmp", little_endian(c, 19, 4)).when(k == "psd", big_endian(c, 19, 4)).when(k == "ico", ico_edge(7))
    )
    height = (
        F.when(k == "png", big_endian(c, 21, 4)).when(k == "gif", little_endian(c, 9, 2))
        .when(k == "bmp", signed(little_endian(c, 23, 4))).when(k == "psd", big_endian(c, 15, 4)).when(k == "ico", ico_edge(8))
    )
    channels = F.when(k == "psd", big_endian(c, 13, 2)).when(
        k == "png", _pick(png_type, {t: v[1] for t, v in PNG_TYPES.items()}, "bigint")
    )
    depth = (
        F.when(k == "png", big_endian(c, 25, 1)).when(k == "psd", big_endian(c, 23, 2))
        .when(k == "gif", F.lit(8)).when((k == "bmp") & (F.length(c) >= 60), little_endian(c, 29, 2))
    )
    mode = (
        F.when(k == "png", _pick(png_type, {t: v[0] for t, v in PNG_TYPES.items()}, "string"))
        .when(k == "psd", _pick(psd_mode, {m: v[0] for m, v in PSD_MODES.items()}, "string"))
        .when(k == "gif", "Indexed")
    )
    colors = _pick(psd_mode, {m: v[1] for m, v in PSD_MODES.items()}, "bigint")
    alpha = F.when(k == "psd", big_endian(c, 13, 2) > colors).when(k == "png", png_type.isin(4, 6))
    valid = k.isNotNull() & ((k != "psd") | big_endian(c, 5, 2).isin(1, 2)) & (width > 0) & (height > 0)
    cells = {
        "kind": k, "width": width.cast("bigint"), "height": height.cast("bigint"), "channels": channels.cast("bigint"),
        "bit_depth": depth.cast("bigint"), "color_mode": mode, "has_alpha_channel": alpha,
        "ok": F.coalesce(valid, F.lit(False)),
    }
    return F.struct(*[v.alias(n) for n, v in cells.items()])


HEAD_BYTES = 32


def probe_headers(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(probed, failures)`` of ``path, content`` rows; one narrow pass, no decoding.
    Only the first bytes are looked at, and turned into hex once per file.  Containers
    without fixed offsets are left to the image source."""
    head = F.hex(F.substring("content", 1, HEAD_BYTES))
    probed = files.withColumn("_p", bind(head, lambda c: bind(_kind(c), lambda k: _fields(c, k))))
    keep = [x for x in files.columns if x != "content"]
    names = ["kind", "width", "height", "channels", "bit_depth", "color_mode", "has_alpha_channel"]
    good = probed.filter("_p.ok").select(*keep, *[F.col(f"_p.{n}").alias(n) for n in names])
    failures = probed.filter(~F.col("_p.ok")).select(*keep, F.lit("unreadable header").alias("reason"))
    return good, failures
