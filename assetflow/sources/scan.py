"""Listing input files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.operators.sets import supported_inputs


def scan_inputs(
    spark: SparkSession, roots: list[str], recursive: bool = True, exts: list[str] | None = None
) -> DataFrame:
    """``path, size_bytes, modified`` of supported files below ``roots``.  The content
    column is not selected, so no file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(roots).select(
        "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")
    )
    return supported_inputs(files, ["path"], exts)


def read_content(spark: SparkSession, roots: list[str], glob: str = "*", max_bytes: int | None = None) -> DataFrame:
    """``path, length, content, truncated``.  A file longer than ``max_bytes`` keeps its row, without content
    and marked, and is not read: the length decides before the two parts are joined."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(roots)
    )
    if max_bytes is None:
        return files.withColumn("truncated", F.lit(False))
    whole = files.filter(F.col("length") <= max_bytes).withColumn("truncated", F.lit(False))
    unread = files.filter(F.col("length") > max_bytes).withColumns({"content": F.lit(None).cast("binary"), "truncated": F.lit(True)})
    return whole.unionByName(unread)
