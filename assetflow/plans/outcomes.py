"""What came of a batch: summaries, progress, failures, history order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.functions.display import progress_percent, remaining_count, run_status
from assetflow.operators.ordered import ordered_scan


def summarize_batch(outcomes: DataFrame, runs: DataFrame, stage_failures: DataFrame | None = None) -> DataFrame:
    """Counts for every row of ``runs``, zeros where nothing was processed; failures of the model stage
    count as inputs that were processed."""
    counts = outcomes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("failed").alias("_failed")
    )
    if stage_failures is not None:
        early = stage_failures.groupBy("run_id").agg(F.count(F.lit(1)).alias("_early"))
        counts = counts.join(early, "run_id", "full").na.fill(0, ["_n", "_failed", "_early"])
    else:
        counts = counts.withColumn("_early", F.lit(0).cast("bigint"))
    joined = runs.join(counts, "run_id", "left").na.fill(0, ["_n", "_failed", "_early"])
    total = F.col("total_count") if "total_count" in runs.columns else F.col("_n") + F.col("_early")
    out = joined.withColumns({
        "processed_count": F.col("_n") + F.col("_early"),
        "success_count": F.col("_n") - F.col("_failed"),
        "failure_count": F.col("_failed") + F.col("_early"),
        "total_count": total,
    }).drop("_n", "_failed", "_early")
    return out.withColumns({
        "remaining_count": remaining_count(F.col("processed_count"), F.col("total_count")),
        "status": run_status(),
        "percent": progress_percent(F.col("processed_count"), F.col("total_count")),
    })


def progress_timeline(outcomes: DataFrame, order: list) -> DataFrame:
    """Running totals per run as files complete; a failed file completes its remaining items.
    The percent needs the run's total, which is one small aggregate joined on."""
    running = ordered_scan(
        outcomes, ["run_id"], order,
        sums={
            "processed_work": F.col("work_items"),
            "processed_files": F.lit(1).cast("bigint"),
            "failed_files": F.col("failed").cast("bigint"),
        },
    )
    totals = outcomes.groupBy("run_id").agg(F.sum("work_items").alias("total_work"))
    return running.join(totals, "run_id").withColumn(
        "percent", progress_percent(F.col("processed_work"), F.col("total_work"))
    )


def failures_of(outcomes: DataFrame, reason: Column) -> DataFrame:
    return outcomes.filter("failed").select("run_id", "item_no", "file_name", reason.alias("reason"))


def ordered_failures(failures: DataFrame, ties: list) -> DataFrame:
    """By file name ignoring case; a range-partitioned sort."""
    return failures.orderBy(F.lower("file_name"), "file_name", *ties)


def recent_runs(runs: DataFrame, n: int = 12) -> DataFrame:
    """Newest runs; a top-n, so each task sends n rows."""
    return runs.orderBy(F.col("run_ts").desc(), F.col("run_id").desc()).limit(n)


def sort_assets(assets: DataFrame, mode: str) -> DataFrame:
    key, direction = mode.rsplit("_", 1)
    by = {
        "name": F.lower("file_name"),
        "size": F.col("size_bytes"),
        "resolution": F.col("width") * F.col("height"),
    }[key]
    return assets.orderBy(by.desc() if direction == "desc" else by.asc(), "asset_id")
