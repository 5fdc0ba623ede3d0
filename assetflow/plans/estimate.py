"""Size estimates of a conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.functions.geometry import half_even, target_dimensions
from assetflow.functions.options import resolve_quality

# Bytes per output format and spread around the estimate.
QUALITY_WEIGHTS = {"jpeg": (0.36, 0.72), "webp": (0.26, 0.58)}
PNG_ALPHA, PNG_OPAQUE = 0.9, 1.35
PLAIN_WEIGHTS = {"gif": 0.82, "tiff": 1.1, "svg": 1.2}
ICON_RANGE = (4096.0, 262144.0)
WIDE_SPREAD, ICON_SPREAD, SPREAD = 0.28, 0.25, 0.18
LEAST_BYTES = 512.0


def with_estimates(plan: DataFrame) -> DataFrame:
    """Adds ``min_bytes`` and ``max_bytes`` per row; no shuffle."""
    width, height = target_dimensions()
    fmt = F.col("output_format")
    one = F.lit(1.0)
    original = F.greatest(one, F.col("size_bytes").cast("double"))
    pixels = F.greatest(one, (F.col("width") * F.col("height")).cast("double"))
    target = F.greatest(one, width.cast("double") * F.greatest(F.lit(1).cast("bigint"), height))
    scaled = original * (target / pixels)
    quality = resolve_quality() / F.lit(100.0)
    base = F.when(fmt == "png", scaled * F.when(F.col("has_alpha"), PNG_ALPHA).otherwise(PNG_OPAQUE))
    for name, (fixed, per_quality) in QUALITY_WEIGHTS.items():
        base = base.when(fmt == name, scaled * (fixed + quality * per_quality))
    for name, weight in PLAIN_WEIGHTS.items():
        base = base.when(fmt == name, scaled * weight)
    base = (
        base.when(fmt == "bmp", target * 4.0 + 64.0)
        .when(fmt == "ico", F.least(F.greatest(target / 5.0, F.lit(ICON_RANGE[0])), F.lit(ICON_RANGE[1])))
        .otherwise(original)
    )
    spread = F.when(fmt.isin("png", "bmp", "svg"), WIDE_SPREAD).when(fmt == "ico", ICON_SPREAD).otherwise(SPREAD)
    low = F.greatest(F.lit(LEAST_BYTES), F.col("_base") * (1.0 - spread))
    return (
        plan.withColumn("_base", base)
        .withColumn("min_bytes", low)
        .withColumn("max_bytes", F.greatest(F.col("min_bytes"), F.col("_base") * (1.0 + spread)))
        .drop("_base")
    )


def estimate_sizes(plan: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals per job.  Row estimates are summed as decimals: the total does not depend on
    the order tasks finish in, and partial sums run before the shuffle."""
    exact = lambda c: F.sum(F.round(c, 6).cast("decimal(28,6)")).cast("double")
    total = lambda c: F.greatest(F.lit(0).cast("bigint"), half_even(exact(c)))
    return with_estimates(plan).groupBy(*(keys or ["job_id"])).agg(
        F.count(F.lit(1)).alias("inputs"),
        F.sum("size_bytes").alias("original_bytes"),
        total("min_bytes").alias("estimated_min"),
        total("max_bytes").alias("estimated_max"),
    )
