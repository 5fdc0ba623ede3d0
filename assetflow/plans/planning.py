"""Per-job rules, diagnostics and warnings of a planned conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.functions.content import model_eligible, needs_unlock
from assetflow.functions.geometry import clamp_index, clamp_range, page_document_mode, page_image_mode
from assetflow.functions.options import compression_risk, supports_alpha
from assetflow.functions.naming import output_folder
from assetflow.operators.sets import warning_list

FRAME_LIMIT = 500  # fixed value: a GIF to PDF conversion above this many frames is flagged


def expands_frames() -> Column:
    return (F.col("frame_count") > 1) & (F.col("gif_mode") == "all") & (F.col("output_format") != "gif")


def work_items() -> Column:
    """Outputs one input makes."""
    pages = F.greatest(F.col("page_count"), F.lit(1).cast("bigint"))
    many = F.when(F.col("output_format") == "pdf", page_document_mode(pages) == "split").otherwise(
        page_image_mode(pages) == "all_pages"
    )
    one = F.lit(1).cast("bigint")
    return (
        F.when(F.col("is_pdf"), F.when(many, pages).otherwise(one))
        .when(expands_frames(), F.greatest(F.col("frame_count"), one))
        .otherwise(one)
    )


def clamp_selection(plan: DataFrame) -> DataFrame:
    """Effective page, frame and ranges (zero-based) and export modes of each input, from
    override columns where they are set and from the job otherwise."""
    pages, frames = F.col("page_count"), F.col("frame_count")
    page_start, page_end = clamp_range(
        F.coalesce("page_from", F.lit(0)), F.coalesce("page_to", F.greatest(pages - 1, F.lit(0))), pages
    )
    frame_start, frame_end = clamp_range(
        F.coalesce("frame_from", F.lit(0)), F.coalesce("frame_to", F.greatest(frames - 1, F.lit(0))), frames
    )
    return plan.withColumns({
        "page_index": clamp_index(F.coalesce("sel_page", "pdf_page_index"), pages),
        "frame_index": clamp_index(F.coalesce("sel_frame", "gif_frame_index"), frames),
        "page_start": page_start,
        "page_end": page_end,
        "frame_start": frame_start,
        "frame_end": frame_end,
        "image_mode": page_image_mode(),
        "document_mode": page_document_mode(),
    })


def rule_aggregates() -> list[Column]:
    """Aggregates behind rules, diagnostics and work totals, so one pass serves all three."""
    eligible = F.col("model_stage") & model_eligible()
    risky = F.when(
        (F.col("output_format") == "pdf") & (F.col("gif_mode") == "all") & (F.col("frame_count") > FRAME_LIMIT),
        F.col("frame_count"),
    ).otherwise(0)
    return [
        F.count(F.lit(1)).alias("inputs"),
        F.count_if(eligible).alias("eligible_inputs"),
        F.count_if(expands_frames()).alias("gif_expansion_inputs"),
        F.count_if(F.col("is_pdf") & (work_items() > 1)).alias("pdf_expansion_inputs"),
        F.count_if(~supports_alpha() & ~F.col("is_pdf") & F.col("has_alpha")).alias("forced_background_inputs"),
        F.bool_or(compression_risk()).alias("high_compression_risk"),
        F.max(risky).cast("bigint").alias("large_frame_count"),
        F.count_if(needs_unlock()).alias("locked_inputs"),
        F.sum(work_items()).alias("work_items"),
        F.bool_or("model_stage").alias("model_enabled"),
    ]


def build_plan(plan: DataFrame, keys: list[str] | None = None, jobs: DataFrame | None = None) -> DataFrame:
    """One wide row per job; with ``jobs`` also for the jobs that have no inputs."""
    keys = keys or ["job_id"]
    rows = plan.groupBy(*keys).agg(*rule_aggregates())
    if jobs is not None:
        every = jobs.select(*keys, F.col("model_stage").alias("_model")).dropDuplicates(keys)
        counts = [c for c, t in rows.dtypes if t == "bigint" and c not in keys]
        rows = every.join(rows, keys, "left").na.fill(0, counts).na.fill(False, ["high_compression_risk"])
        rows = rows.withColumn("model_enabled", F.coalesce("model_enabled", "_model")).drop("_model")
    return rows.withColumns({
        "expands_gif_frames": F.col("gif_expansion_inputs") > 0,
        "expands_pdf_pages": F.col("pdf_expansion_inputs") > 0,
        "bypassed_inputs": F.col("inputs") - F.col("eligible_inputs"),
        "scale_disclaimer": F.col("model_enabled") & (F.col("eligible_inputs") > 0),
        "expansion_disclaimer": (F.col("gif_expansion_inputs") > 0) | (F.col("pdf_expansion_inputs") > 0),
        "total_work_items": F.col("work_items") + F.col("eligible_inputs"),
    })


def plan_rules(plan: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    return build_plan(plan, jobs=jobs).select(
        "job_id", "inputs", "model_enabled", "eligible_inputs", "gif_expansion_inputs", "expands_gif_frames",
        "pdf_expansion_inputs", "expands_pdf_pages", "forced_background_inputs",
    )


def plan_diagnostics(plan: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    return build_plan(plan, jobs=jobs).select(
        "job_id", "high_compression_risk", "large_frame_count", "locked_inputs", "scale_disclaimer", "expansion_disclaimer"
    )


def count_work_items(plan: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    return build_plan(plan, jobs=jobs).select("job_id", "work_items", "eligible_inputs", "total_work_items")


def output_directories(plan: DataFrame, key: str = "job_id") -> DataFrame:
    """Distinct output folders per run, sorted by job and name ignoring case.  The global
    sort is by ranges, so a job with very many folders is spread over tasks."""
    return plan.select(key, output_folder().alias("folder")).distinct().orderBy(key, F.lower("folder"), "folder")


# Wording of plan warnings; callers may pass translations.
WARNING_TEXTS = {
    "forced_background": "%d inputs get a solid background",
    "high_compression": "Strong compression may be visible",
    "large_frames": "A GIF has %d frames",
    "bypassed": "%d inputs skip the model stage",
    "locked": "%d locked documents are skipped",
}


def plan_warnings(jobs_plan: DataFrame, texts: dict[str, str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Warnings of each plan row of :func:`build_plan`, in fixed order."""
    t = WARNING_TEXTS | (texts or {})
    fill = lambda name, column: F.format_string(t[name], F.col(column))
    return warning_list(
        jobs_plan,
        [
            (F.col("forced_background_inputs") > 0, fill("forced_background", "forced_background_inputs")),
            (F.col("high_compression_risk"), F.lit(t["high_compression"])),
            (F.col("large_frame_count") > 0, fill("large_frames", "large_frame_count")),
            (F.col("model_enabled") & (F.col("bypassed_inputs") > 0), fill("bypassed", "bypassed_inputs")),
            (F.col("locked_inputs") > 0, fill("locked", "locked_inputs")),
        ],
        keys or ["job_id"],
    )
