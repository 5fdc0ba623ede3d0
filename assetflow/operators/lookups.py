"""Keyed look-ups.  Sides are joined without forced broadcasts: Spark broadcasts what
its size estimate allows and splits skewed partitions otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the highest ``order``; partial aggregates run first."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def apply_overrides(assets_jobs: DataFrame, overrides: DataFrame, order: str = "asset_id") -> DataFrame:
    """Per-path choices over job defaults.

    Adds ``sel_page, sel_frame`` (null without an override) and the four range ends.
    The kinds are folded into one row per path first, so there is a single join
    whatever the number of kinds.
    """
    keyed = overrides.withColumn("_key", F.lower("path_key"))

    def last(kind: str, column: str) -> Column:
        # both ends come from one row, also where rows share the highest order
        newest = F.max(F.when(F.col("kind") == kind, F.struct(order, "start_index", "end_index")))
        return newest[column]

    folded = keyed.groupBy("job_id", "_key").agg(
        last("page", "start_index").alias("sel_page"),
        last("frame", "start_index").alias("sel_frame"),
        last("page_range", "start_index").alias("page_from"),
        last("page_range", "end_index").alias("page_to"),
        last("frame_range", "start_index").alias("frame_from"),
        last("frame_range", "end_index").alias("frame_to"),
    )
    return assets_jobs.withColumn("_key", F.lower("path")).join(folded, ["job_id", "_key"], "left").drop("_key")


def lock_skips(
    assets: DataFrame, unlocks: DataFrame | None = None, reason: str = "locked", keys: list[str] | None = None
) -> DataFrame:
    """``locked`` and ``skip_reason``; ``unlocks(*keys, path_key, unlocked)`` may lock a document again."""
    keys = keys or []
    needs = F.col("is_encrypted") & ~F.col("is_unlocked")
    if unlocks is None:
        out = assets.withColumn("locked", F.col("is_pdf") & needs)
    else:
        side = unlocks.groupBy(*keys, F.lower("path_key").alias("_key")).agg(F.bool_and("unlocked").alias("_unlocked"))
        out = assets.withColumn("_key", F.lower("path")).join(side, [*keys, "_key"], "left")
        out = out.withColumn("locked", F.col("is_pdf") & (needs | ~F.coalesce("_unlocked", F.lit(True))))
        out = out.drop("_key", "_unlocked")
    return out.withColumn("skip_reason", F.when(F.col("locked"), reason))


def exclude_failed(assets: DataFrame, failures: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Inputs that failed the model stage are not converted."""
    keys = keys or []
    left = assets.withColumn("_key", F.lower("path"))
    right = failures.select(*keys, F.lower("path").alias("_key"))
    return left.join(right, [*keys, "_key"], "left_anti").drop("_key")


def input_overrides(assets: DataFrame, produced: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``actual_path``: the file produced for an input (of the same ``keys``) when there is one, else the input."""
    keys = keys or []
    side = produced.groupBy(*keys, F.lower("path").alias("_key")).agg(F.max("output_path").alias("_out"))
    return (
        assets.withColumn("_key", F.lower("path"))
        .join(side, [*keys, "_key"], "left")
        .withColumn("actual_path", F.coalesce(F.when(F.trim("_out") != "", F.col("_out")), F.col("path")))
        .drop("_key", "_out")
    )


def translate(keys: DataFrame, strings: DataFrame, locale: str, base: str) -> DataFrame:
    """Value in the active locale, else in the fallback, else the key itself.
    Both locales are folded into one row per key, so one join serves both look-ups."""
    value = lambda code: F.min(F.when(F.col("locale") == code, F.col("value")))
    folded = (
        strings.filter(F.col("locale").isin(locale, base))
        .groupBy("key")
        .agg(value(locale).alias("_a"), value(base).alias("_b"))
    )
    return keys.join(folded, "key", "left").select(
        *keys.columns, F.coalesce("_a", "_b", "key").alias("text")
    )


def resolve_model(jobs: DataFrame, models: DataFrame, standard: str = "standard", fallback: str = "general") -> DataFrame:
    """``requested_model, resolved_model, used_fallback, model_error``.

    ``models(model_code, retired, available)``: a retired code means the standard model;
    a model that is not available is replaced by the fallback, if that is.
    """
    known = models.groupBy("model_code").agg(
        F.bool_or("retired").alias("_retired"), F.bool_or("available").alias("_available")
    )
    retired = known.select(F.col("model_code"), "_retired")
    ready = known.filter("_available").select(F.col("model_code").alias("requested_model"), F.lit(True).alias("_ok"))
    named = jobs.join(retired, "model_code", "left").withColumn(
        "requested_model", F.when(F.coalesce("_retired", F.lit(False)), standard).otherwise(F.col("model_code"))
    )
    joined = named.join(ready, "requested_model", "left")
    fallback_ok = models.filter((F.col("model_code") == fallback) & F.col("available")).agg(
        (F.count(F.lit(1)) > 0).alias("ok")
    )
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    has_fallback = fallback_ok.scalar()
    resolved = F.when(ok, F.col("requested_model")).when(has_fallback, F.lit(fallback))
    return joined.withColumn("resolved_model", resolved).withColumns({
        "used_fallback": F.coalesce(F.col("resolved_model") != F.col("requested_model"), F.lit(False)),
        "model_error": F.when(F.col("resolved_model").isNull(), "no model available"),
    }).drop("_retired", "_ok")
