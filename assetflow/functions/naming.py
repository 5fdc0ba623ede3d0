"""Output names and folders of one planned row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.functions.content import directory_of, stem_of
from assetflow.functions.options import is_blank

# Characters a file name may not hold (code points 0-31 and these).
INVALID_NAME_CHARS = r'[\x00-\x1F"<>|:*?\\/]'


def sanitize(col: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), INVALID_NAME_CHARS, "")


def zero_padded(number: Column, digits: Column) -> Column:
    """Left-padded with zeros; a longer number keeps all its digits."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(digits.cast("int"), F.length(text)), F.lit("0"))


def output_base_name(path: str = "path", index: str = "batch_index") -> Column:
    original = stem_of(path)
    mode = F.col("rename_mode")
    return (
        F.when(mode == "number", zero_padded(F.col("rename_start") + F.col(index), F.col("rename_digits")))
        .when(mode == "prefix", F.concat(sanitize("rename_prefix"), original))
        .when(mode == "suffix", F.concat(original, sanitize("rename_suffix")))
        .otherwise(original)
    )


def output_folder(path: str = "path") -> Column:
    source = directory_of(path)
    chosen = F.when(is_blank("output_directory"), source).otherwise(F.col("output_directory"))
    rule = F.col("folder_rule")
    return (
        F.when(rule == "specific", chosen)
        .when(rule == "auto", F.concat(F.regexp_replace(chosen, r"[/\\]+$", ""), F.lit("/"), F.col("auto_folder")))
        .otherwise(source)
    )


def with_trailing_separator(col: Column) -> Column:
    return F.when(col.rlike(r"[/\\]$"), col).otherwise(F.concat(col, F.lit("/")))


def paths_overlap(first: Column | str, second: Column | str) -> Column:
    a = F.lower(with_trailing_separator(F.col(first) if isinstance(first, str) else first))
    b = F.lower(with_trailing_separator(F.col(second) if isinstance(second, str) else second))
    return F.startswith(a, b) | F.startswith(b, a)


def validate_profiles(profiles: DataFrame, known: Column | None = None) -> DataFrame:
    """``problem`` is null for a usable profile, else the first failed check.
    ``known`` says whether the input directory exists; by default it does."""
    known = F.lit(True) if known is None else known
    overlap = paths_overlap("input_directory", "output_directory")
    return profiles.withColumns({
        "overlaps": overlap,
        "problem": F.when(is_blank("input_directory") | ~known, "invalid_input")
        .when(is_blank("output_directory"), "invalid_output")
        .when(overlap, "overlap"),
    })
