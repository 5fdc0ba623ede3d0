"""Named option presets in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.schemas import PRESET, PRESET_DEFAULTS


def load_presets(stored: DataFrame, retired: list[str], standard: str = "standard") -> DataFrame:
    """Typed presets from ``saved_at, body``: missing fields take their default, retired
    model codes become the standard model."""
    parsed = stored.select("saved_at", F.from_json("body", PRESET).alias("p"))
    cells = [F.coalesce(F.col(f"p.{n}"), F.lit(PRESET_DEFAULTS[n])).cast(PRESET[n].dataType).alias(n) for n in PRESET.names]
    typed = parsed.select("saved_at", *cells).withColumn("name", F.trim("name"))
    return typed.withColumn(
        "model_code", F.when(F.col("model_code").isin(retired), standard).otherwise(F.col("model_code"))
    )


def upsert(presets: DataFrame, updates: DataFrame | None = None) -> DataFrame:
    """Latest preset per name ignoring case, in the place of the first one; blank names are dropped."""
    rows = presets if updates is None else presets.unionByName(updates)
    named = rows.filter(F.trim("name") != "").withColumn("_key", F.lower("name"))
    rest = [c for c in rows.columns if c != "saved_at"]
    picked = named.groupBy("_key").agg(
        F.min("saved_at").alias("position"), F.max(F.struct("saved_at", *rest)).alias("p")
    )
    return picked.select("position", *[F.col(f"p.{c}").alias(c) for c in rest])


def dump_presets(presets: DataFrame) -> DataFrame:
    return presets.select("position", F.to_json(F.struct(*PRESET.names)).alias("body"))
