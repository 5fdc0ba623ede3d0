"""Summaries of layered documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.operators.ordered import first_per_key

# Channel compression codes.
COMPRESSION_CODES = {0: "Raw", 1: "RLE", 2: "ZIP", 3: "ZIP Prediction"}


def summarize_layers(layers: DataFrame, order: list[str], sample: int = 5) -> DataFrame:
    """Counts, sizes, flags and the first ``sample`` names per document; group ends are
    markers, not layers.  Names go through a per-task top-n, so no list grows with the
    layers of a document."""
    real = layers.filter(~F.col("is_group_end"))
    group = F.col("is_group_start")
    text = ~group & F.col("is_text")
    shape = ~group & ~F.col("is_text") & F.col("is_shape")
    positive = lambda c: F.when(F.max(c) > 0, F.max(c))
    counts = real.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("layers"),
        F.count_if(~F.col("is_hidden")).alias("visible"),
        F.count_if("is_hidden").alias("hidden"),
        F.count_if(group).alias("groups"),
        F.count_if(text).alias("texts"),
        F.count_if(shape).alias("shapes"),
        F.count_if(~group & ~F.col("is_text") & ~F.col("is_shape")).alias("images"),
        F.count_if("is_locked").alias("locked"),
        positive("width").alias("max_width"),
        positive("height").alias("max_height"),
        F.bool_or(text).alias("has_text"),
        F.bool_or("is_smart").alias("has_smart"),
        F.bool_or(shape | F.col("has_vector_path")).alias("has_vector"),
    )
    named = real.filter(F.trim("name") != "").select("doc_id", *order, "name")
    names = (
        first_per_key(named, ["doc_id"], order, sample)
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct(*order, "name"))).alias("_n"))
        .select("doc_id", F.array_join(F.transform("_n", lambda s: s["name"]), ", ").alias("sample_names"))
    )
    return counts.join(names, "doc_id", "left")


def layer_compression(layers: DataFrame) -> DataFrame:
    """Distinct labels per document, sorted; null when none is known.  At most four labels exist."""
    label = None
    for code, name in COMPRESSION_CODES.items():
        test = F.col("compression_code") == code
        label = F.when(test, name) if label is None else label.when(test, name)
    labels = F.array_join(F.array_sort(F.collect_set(label)), ", ")
    return layers.groupBy("doc_id").agg(F.nullif(labels, F.lit("")).alias("compression"))
