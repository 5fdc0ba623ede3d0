"""Ordered set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.functions.content import extension_of
from assetflow.operators.ordered import first_per_key
from assetflow.schemas import SUPPORTED_INPUTS


def distinct_paths(df: DataFrame, order: list, path: str = "path") -> DataFrame:
    """Case-insensitive distinct, the first row (in ``order``) of each path wins."""
    return first_per_key(df, [F.lower(path)], order)


def supported_inputs(listing: DataFrame, order: list, exts: list[str] | None = None) -> DataFrame:
    """Files of the allowed extensions, each path once."""
    wanted = listing.filter(F.lower(extension_of("path")).isin(exts or SUPPORTED_INPUTS))
    return distinct_paths(wanted, order)


def import_new(candidates: DataFrame, catalog: DataFrame, order: list) -> tuple[DataFrame, DataFrame]:
    """``(new assets, failures)``: paths already catalogued are dropped; a candidate whose
    probe failed becomes a failure row instead of stopping the batch."""
    known = catalog.select(F.lower("path").alias("_key"))
    fresh = distinct_paths(
        candidates.withColumn("_key", F.lower("path")).join(known, "_key", "left_anti").drop("_key"), order
    )
    failures = fresh.filter(~F.col("probe_ok")).select(
        F.regexp_extract("path", r"([^/\\]*)$", 1).alias("file_name"), "reason"
    )
    return fresh.filter(F.col("probe_ok")).drop("probe_ok", "reason"), failures


def merge_path_requests(first: DataFrame, second: DataFrame, order: str = "ord") -> DataFrame:
    """Both requests in turn: trimmed, blanks dropped, each path once ignoring case."""
    both = first.select(F.lit(0).alias("_part"), order, "path").unionByName(
        second.select(F.lit(1).alias("_part"), order, "path")
    )
    cleaned = both.withColumn("path", F.trim("path")).filter(F.col("path") != "")
    return distinct_paths(cleaned, ["_part", order, "path"]).select("path")


def locale_coverage(strings: DataFrame, base: str) -> DataFrame:
    """Per locale: base keys it lacks, keys the base lacks, values equal to the base."""
    values = strings.groupBy("locale", "key").agg(F.min("value").alias("value"))
    reference = values.filter(F.col("locale") == base).select("key", F.col("value").alias("_base"))
    counted = (
        values.join(reference, "key", "left")
        .groupBy("locale")
        .agg(
            F.count_if(F.col("_base").isNotNull()).alias("_shared"),
            F.count_if(F.col("_base").isNull()).alias("extra_keys"),
            F.count_if(F.col("_base") == F.col("value")).alias("same_as_base"),
        )
    )
    total = reference.agg(F.count(F.lit(1))).scalar()
    return counted.select("locale", (total - F.col("_shared")).alias("missing_keys"), "extra_keys", "same_as_base")


# Code formats a detector may be asked for, and how they are shown.
CODE_FORMATS = {
    "CODE_128": "Code128",
    "CODE_39": "Code39",
    "CODE_93": "Code93",
    "EAN_13": "EAN-13",
    "EAN_8": "EAN-8",
    "UPC_A": "UPC-A",
    "UPC_E": "UPC-E",
    "ITF": "ITF",
    "CODABAR": "Codabar",
    "MSI": "MSI",
    "RSS_14": "RSS-14",
    "RSS_EXPANDED": "RSS Expanded",
    "AZTEC": "Aztec",
    "DATA_MATRIX": "Data Matrix",
    "PDF_417": "PDF417",
    "QR_CODE": "QR",
}


def allowed_formats(configured: Column, wanted: list[str]) -> Column:
    """The configured list (any case, ``-`` or blank for ``_``), unknown names dropped and
    duplicates removed, all formats when nothing is left; then those of ``wanted``."""
    everything = F.array(*[F.lit(c) for c in CODE_FORMATS])
    named = F.transform(
        F.coalesce(configured, F.array().cast("array<string>")),
        lambda c: F.translate(F.upper(F.trim(c)), "- ", "__"),
    )
    known = F.array_intersect(named, everything)
    chosen = F.when(F.size(known) > 0, known).otherwise(everything)
    return F.array_intersect(chosen, F.array(*[F.lit(c) for c in wanted]))


def format_label(code: Column) -> Column:
    out = None
    for name, label in CODE_FORMATS.items():
        out = F.when(code == name, label) if out is None else out.when(code == name, label)
    return out.otherwise(code)


def warning_list(plan: DataFrame, texts: list[tuple[Column, Column]], keys: list[str]) -> DataFrame:
    """``keys, ord, warning``: texts whose test holds, blanks and repeats dropped, order kept."""
    cells = F.array(*[F.when(test, text) for test, text in texts])
    shown = F.array_distinct(F.filter(cells, lambda t: t.isNotNull() & (F.trim(t) != "")))
    rows = plan.select(*keys, F.posexplode(shown).alias("ord", "warning"))
    return rows.withColumn("ord", F.col("ord").cast("bigint"))
