"""Which way an input is converted, and the outputs it unfolds into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.functions.options import output_extension


def route_conversion() -> Column:
    """Ordered dispatch of a row to one strategy code."""
    e, out, mode = F.lower("ext"), F.col("output_format"), F.col("gif_mode")
    gif, animated = e == ".gif", F.col("frame_count") > 1
    return (
        F.when((e == ".pdf") & (out == "pdf") & (F.col("document_mode") == "split"), "pdf_split")
        .when((e == ".pdf") & (out == "pdf"), "pdf_document")
        .when((e == ".pdf") & (F.col("page_count") > 1) & (F.col("image_mode") == "all_pages"), "pdf_pages")
        .when(e == ".pdf", "pdf_page")
        .when(gif & (out == "pdf") & animated & (mode == "all"), "gif_pdf_frames")
        .when(gif & (out == "pdf") & animated & (mode == "specific"), "gif_specific_pdf")
        .when(out == "pdf", "source_to_pdf")
        .when(gif & (mode == "all") & animated & (out != "gif"), "gif_frames")
        .when(gif & (mode == "specific") & (out != "gif"), "gif_specific")
        .when(out == "svg", "svg")
        .when(gif & (out == "gif"), "animated_gif")
        .otherwise("raster")
    )


# Strategies that write into a folder named after the input.
FOLDER_STRATEGIES = ["pdf_split", "pdf_pages", "gif_pdf_frames", "gif_specific_pdf", "gif_frames"]


def makes_folder() -> Column:
    return F.col("strategy").isin(FOLDER_STRATEGIES)


def expand_pages(routed: DataFrame) -> DataFrame:
    """Output rows of document inputs: ``output_no`` (one-based), ``page_from, page_to``
    (zero-based) and ``output_name`` inside the input's folder (null for a single file)."""
    docs = routed.filter(F.col("strategy").isin("pdf_split", "pdf_document", "pdf_pages", "pdf_page"))
    each = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("page_count") - 1, F.lit(0))),
        lambda i: F.struct(i.alias("first"), i.alias("last")),
    )
    last_page = F.greatest(F.col("page_count") - 1, F.lit(0))
    single = F.array(F.struct(F.col("page_index").alias("first"), F.col("page_index").alias("last")))
    ranged = F.array(F.struct(F.col("page_start").alias("first"), F.col("page_end").alias("last")))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("first"), last_page.alias("last")))
    spans = (
        F.when(F.col("strategy").isin("pdf_split", "pdf_pages"), each)
        .when(F.col("strategy") == "pdf_page", single)
        .when(F.col("document_mode") == "current_page", single)
        .when(F.col("document_mode") == "page_range", ranged)
        .otherwise(whole)
    )
    rows = docs.drop("page_from", "page_to").select("*", F.posexplode(spans).alias("_n", "_s"))
    ext = F.when(F.col("strategy") == "pdf_split", ".pdf").otherwise(output_extension())
    return rows.withColumns({
        "output_no": F.col("_n").cast("bigint") + 1,
        "page_from": F.col("_s.first"),
        "page_to": F.col("_s.last"),
        "output_name": F.when(makes_folder(), F.concat(F.lit("page_"), (F.col("_s.first") + 1).cast("string"), ext)),
    }).drop("_n", "_s")


def expand_frames(routed: DataFrame) -> DataFrame:
    """Output rows of GIF inputs: ``output_no``, ``frame_no`` (zero-based, null when the
    whole animation or still goes into one file) and ``output_name`` inside the folder."""
    gifs = routed.filter(F.lower("ext") == ".gif")
    every = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("frame_count") - 1, F.lit(0)))
    # a chosen frame outside a folder is only kept from being negative here
    numbers = (
        F.when(F.col("strategy").isin("gif_pdf_frames", "gif_frames"), every)
        .when(F.col("strategy").isin("gif_specific_pdf", "gif_specific"), F.array("frame_index"))
        .otherwise(F.array(F.lit(None).cast("bigint")))
    )
    rows = gifs.select("*", F.posexplode(numbers).alias("_n", "frame_no"))
    ext = F.when(F.col("output_format") == "pdf", ".pdf").otherwise(output_extension())
    return rows.withColumns({
        "output_no": F.col("_n").cast("bigint") + 1,
        "output_name": F.when(
            makes_folder(), F.concat(F.lit("frame_"), (F.col("frame_no") + 1).cast("string"), ext)
        ),
    }).drop("_n")


def expand_outputs(routed: DataFrame) -> DataFrame:
    """Every output row of a routed plan: pages, frames and single files together.
    One pass: the unfolded arrays are chosen per row, so nothing is read twice."""
    last_page = F.greatest(F.col("page_count") - 1, F.lit(0))
    last_frame = F.greatest(F.col("frame_count") - 1, F.lit(0))
    zero = F.lit(0).cast("bigint")
    numbers = (
        F.when(F.col("strategy").isin("pdf_split", "pdf_pages"), F.sequence(zero, last_page))
        .when(F.col("strategy").isin("gif_pdf_frames", "gif_frames"), F.sequence(zero, last_frame))
        .when(F.col("strategy").isin("gif_specific_pdf", "gif_specific"), F.array("frame_index"))
        .when(F.col("strategy") == "pdf_page", F.array("page_index"))
        .otherwise(F.array(F.lit(None).cast("bigint")))
    )
    rows = routed.select("*", F.posexplode(numbers).alias("_n", "part"))
    word = F.when(F.col("strategy").isin("pdf_split", "pdf_pages"), "page_").otherwise("frame_")
    ext = F.when(F.col("output_format") == "pdf", ".pdf").otherwise(output_extension())
    name = F.when(makes_folder(), F.concat(word, (F.col("part") + 1).cast("string"), ext))
    return rows.withColumns({"output_no": F.col("_n").cast("bigint") + 1, "output_name": name}).drop("_n")
