"""Decoded rasters through Spark's image source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pixels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rasters, failures)``.  ``data`` holds interleaved bytes, blue first, as decoded;
    files the JVM cannot decode are reported instead of dropped."""
    loaded = spark.read.format("image").load(path).select("image.*")
    good = loaded.filter(F.col("height") > 0)
    bad = loaded.filter(F.col("height") <= 0).select(
        F.regexp_extract("origin", r"([^/\\]*)$", 1).alias("file_name"), F.lit("not decodable").alias("reason")
    )
    return good.select("origin", "width", "height", "nChannels", "data"), bad


def pixel_arrays(images: DataFrame, key: str = "origin") -> DataFrame:
    """``image_id, width, height, px`` from :func:`read_pixels` rows, one array per image."""
    digits = F.hex("data")
    byte = lambda at: F.conv(F.substring(digits, (at * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("bigint")
    n = F.col("nChannels")
    opaque = F.lit(255).cast("bigint")

    def one(i):
        at = i * n
        gray = n == 1
        return F.struct(
            byte(at + F.when(gray, 0).otherwise(2)).alias("r"),
            byte(at + F.when(gray, 0).otherwise(1)).alias("g"),
            byte(at).alias("b"),
            F.when(n == 4, byte(at + 3)).otherwise(opaque).alias("a"),
        )

    count = F.col("width") * F.col("height")
    return images.select(
        F.col(key).alias("image_id"), F.col("width").cast("bigint").alias("width"),
        F.col("height").cast("bigint").alias("height"),
        F.transform(F.sequence(F.lit(0), count - 1), one).alias("px"),
    )
