"""Detail sheets of assets as rows and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.functions import content as C
from assetflow.functions.display import format_bytes, grouped


def _yes_no(col: Column) -> Column:
    return F.when(col, "Yes").when(~col, "No")


def _size(width: str, height: str) -> Column:
    return F.when((F.col(width) > 0) & (F.col(height) > 0), F.concat_ws(" x ", width, height))


# Fields of a sheet that need a column of their own (joined on beforehand, for instance from
# layer summaries or camera data): section, label, column, and the extensions they belong to.
OPTIONAL_ENTRIES = [
    ("Image", "Camera", "camera_model", None),
    ("Image", "Date taken", "date_taken", None),
    ("Image", "ISO", "iso", None),
    ("Image", "Aperture", "aperture", None),
    ("Image", "Shutter", "shutter", None),
    ("Image", "Frame rate", "fps", None),
    ("Layers", "Layer count", "layers", [".psd"]),
    ("Layers", "Visible layers", "visible", [".psd"]),
    ("Layers", "Hidden layers", "hidden", [".psd"]),
    ("Layers", "Layer groups", "groups", [".psd"]),
    ("Layers", "Layer names", "sample_names", [".psd"]),
    ("Layers", "Text layers", "has_text", [".psd"]),
    ("Layers", "Smart objects", "has_smart", [".psd"]),
    ("Layers", "Vector paths", "has_vector", [".psd"]),
    ("Layers", "Layer compression", "compression", [".psd"]),
    ("Document details", "Version", "version", [".pdf"]),
    ("Document details", "Author", "author", [".pdf"]),
    ("Document details", "Producer", "producer", [".pdf"]),
    ("Document details", "Title", "title", [".pdf"]),
    ("Executable", "File version", "file_version", [".exe"]),
    ("Executable", "Product name", "product_name", [".exe"]),
    ("Executable", "Company name", "company_name", [".exe"]),
    ("Shortcut", "Target path", "target_path", [".lnk"]),
    ("Shortcut", "Arguments", "arguments", [".lnk"]),
]


def detail_entries(columns: list[str] | None = None, types: dict[str, str] | None = None) -> list[tuple[str, str, Column]]:
    """(section, label, value) of the fields an asset row carries; unknown values are null."""
    size = F.concat(format_bytes("size_bytes"), F.lit(" ("), grouped(F.col("size_bytes")), F.lit(" B)"))
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    image = ~F.col("is_pdf")
    entries = [
        ("General", "Name", F.col("file_name")),
        ("General", "Path", F.col("path")),
        ("General", "File type", F.concat(F.lit("."), F.upper(F.ltrim(F.col("ext"), F.lit("."))))),
        ("General", "Size", size),
        ("Image", "Resolution", F.when(image, _size("width", "height"))),
        ("Image", "Pixel count", F.when(image & sized, grouped(F.col("width") * F.col("height")))),
        ("Image", "Color mode", F.when(image, F.when(F.col("has_alpha"), "RGBA").otherwise("RGB"))),
        ("Image", "Transparency", F.when(image, _yes_no(F.col("has_alpha")))),
        ("Image", "Compression", F.when(image, C.compression_label())),
        ("Image", "Animation frames", F.when(image & (F.col("frame_count") > 1), grouped(F.col("frame_count")))),
        ("Document", "Page count", F.when(F.col("is_pdf") & (F.col("page_count") > 0), grouped(F.col("page_count")))),
        ("Document", "Encrypted", F.when(F.col("is_pdf"), _yes_no(F.col("is_encrypted")))),
        ("Document", "Copy allowed", F.when(F.col("is_pdf") & ~F.col("is_encrypted"), F.lit("Yes"))),
    ]
    for section, label, name, exts in OPTIONAL_ENTRIES:
        if name not in (columns or []):
            continue
        value = _yes_no(F.col(name)) if (types or {}).get(name) == "boolean" else F.col(name).cast("string")
        entries.append((section, label, F.when(F.lower("ext").isin(exts), value) if exts else value))
    sections = list(dict.fromkeys(section for section, _, _ in entries))
    return sorted(entries, key=lambda e: sections.index(e[0]))


def detail_rows(assets: DataFrame, key: str = "asset_id") -> DataFrame:
    """Wide metadata as ``key, section, ord, label, value``; one projection and one explode.
    Columns named in ``OPTIONAL_ENTRIES`` add their entries when they are there."""
    cells = F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(n).cast("bigint").alias("ord"), F.lit(label).alias("label"), v.alias("value"))
        for n, (s, label, v) in enumerate(detail_entries(assets.columns, dict(assets.dtypes)))
    ])
    return assets.select(key, F.explode(cells).alias("e")).select(key, "e.section", "e.ord", "e.label", "e.value")


def detail_text(rows: DataFrame, key: str = "asset_id", unknown: str = "Unknown") -> DataFrame:
    """Sections and entries of each asset joined to one text; a sheet has a fixed number of
    entries, so the list per asset is small."""
    line = F.concat("label", F.lit(": "), F.coalesce("value", F.lit(unknown)))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "section", line.alias("line")))).alias("_l"))
    # a section title opens each run of entries of one section
    lines = F.transform(
        "_l",
        lambda e, i: F.when(
            (i == 0) | (F.get(F.col("_l"), i - 1)["section"] != e["section"]),
            F.concat(F.lit("["), e["section"], F.lit("]\n"), e["line"]),
        ).otherwise(e["line"]),
    )
    return listed.select(key, F.array_join(lines, "\n").alias("text"))
