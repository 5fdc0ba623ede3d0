"""Frame tables of animations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.functions.geometry import clamp_range, target_dimensions
from assetflow.functions.options import resolve_quality
from assetflow.operators.ordered import ordered_scan

# Delay (in 1/100 s) before any positive one was seen, least fallback in ms.
DEFAULT_DELAY_CS, LEAST_DELAY_MS = 10, 20


def frame_rate(frames: DataFrame, key: str = "asset_id") -> DataFrame:
    """Frames per second from the positive durations, only for more than one frame."""
    positive = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    rated = frames.groupBy(key).agg(F.count(F.lit(1)).alias("frames"), F.avg(positive).alias("_m"))
    return rated.select(
        key, "frames", F.when(F.col("frames") > 1, F.try_divide(F.lit(1000.0), F.col("_m"))).alias("fps")
    )


def frame_delays(frames: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``delay_ms`` per frame: a missing or non-positive delay repeats the last positive one."""
    positive = F.when(F.col("delay_cs") > 0, F.col("delay_cs"))
    seen = ordered_scan(frames, keys, order, carries={"_last": positive})
    delay = F.coalesce(positive, F.col("_last"), F.lit(DEFAULT_DELAY_CS)) * 10
    return seen.withColumn("delay_ms", delay.cast("bigint")).drop("_last")


def padded_frames(frames: DataFrame, counts: DataFrame, key: str = "asset_id") -> DataFrame:
    """One row per frame 0 .. frame_count-1, frames beyond the delay table with a null delay;
    feed it to :func:`frame_delays` to have them inherit."""
    wanted = counts.filter(F.col("frame_count") > 0).select(
        key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("frame_count") - 1)).alias("frame_no")
    )
    return wanted.join(frames.select(key, "frame_no", "delay_cs"), [key, "frame_no"], "left")


def fallback_delay(duration_ms):
    """Delay of a frame when the delay table cannot be read."""
    return F.greatest(F.lit(LEAST_DELAY_MS), F.coalesce(duration_ms, F.lit(0)))


def trim_frames(plan: DataFrame) -> DataFrame:
    """Frames of GIF to GIF conversions inside the chosen range.  An animation that keeps its
    size, colours and full range is passed through as one row (``frame_no`` null)."""
    n = F.col("frame_count")
    start, end = clamp_range(
        F.coalesce("frame_from", F.lit(0)), F.coalesce("frame_to", n - 1), n
    )
    width, height = target_dimensions()
    same_size = (width == F.col("width")) & (height == F.col("height")) & (F.col("resize_mode") == "none")
    full = (F.col("_start") == 0) & (F.col("_end") == n - 1)
    gifs = plan.filter((F.lower("ext") == ".gif") & (F.col("output_format") == "gif"))
    ranged = gifs.withColumns({"_start": start, "_end": end})
    flagged = ranged.withColumn(
        "is_passthrough", (n > 1) & same_size & (resolve_quality(gif=True) >= 100) & full
    )
    numbers = F.when(F.col("is_passthrough"), F.array(F.lit(None).cast("bigint"))).otherwise(
        F.sequence("_start", "_end")
    )
    return flagged.withColumn("frame_no", F.explode(numbers)).drop("_start", "_end")
