"""Failure logs as text lines, for runs that had failures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.functions.display import format_duration
from assetflow.operators.ordered import group_limit, row_numbers
from assetflow.session import freeze


# Wording of the log; callers may pass their own.
LABELS = {
    "title": "Run report", "inputs": "Inputs:", "failures": "Not converted:", "run_ts": "at", "trigger_source": "started by",
    "output_format": "to", "compression_mode": "compression", "quality": "quality", "resize_mode": "resizing", "gif_mode": "animations",
    "total_count": "inputs", "processed_count": "done", "success_count": "good", "failure_count": "bad", "was_canceled": "stopped early",
    "duration_ms": "took",
}
# Options a run was made with, shown where the summary carries the column.
OPTIONS = ["compression_mode", "quality", "resize_mode", "gif_mode"]


def header_lines(columns: list[str], labels: dict[str, str]) -> list[Column]:
    """The opening block of a run's log, from its summary row."""
    line = lambda name, value: F.concat(F.lit(f"{labels[name]}: "), F.coalesce(value.cast("string"), F.lit("")))
    plain = ["trigger_source", "output_format", *[n for n in OPTIONS if n in columns]]
    counts = ["total_count", "processed_count", "success_count", "failure_count", "was_canceled"]
    lines = [F.lit(labels["title"])]
    if "run_ts" in columns:
        lines.append(line("run_ts", F.date_format("run_ts", "yyyy-MM-dd HH:mm:ss")))
    lines += [line(n, F.col(n)) for n in [*plain, *counts]]
    if "duration_ms" in columns:
        lines.append(line("duration_ms", format_duration("duration_ms")))
    return [*lines, F.lit(""), F.lit(labels["inputs"])]


TASK_ROWS = 500_000  # lines a task sorts, about


def failure_log(
    summary: DataFrame, inputs: DataFrame, failures: DataFrame, input_order: list, ties: list, labels: dict[str, str] | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``run_id, line_no, line``.  Inputs keep their order; failures go by name ignoring case.
    Lines are numbered with :func:`row_numbers`, so a run of any size is never gathered.  The summaries of
    failing runs, a row each, are computed once; their counts tell whether a run is too big for one task.
    Else the runs are dealt out by the number of rows, ``task_rows`` to a task, so a task's sorts do not grow with the input."""
    labels = LABELS | (labels or {})
    head = header_lines(summary.columns, labels)
    around = [*head, F.lit(""), F.lit(labels["failures"])]
    failing = freeze(
        summary.filter(F.col("failure_count") > 0).select("run_id", "total_count", "failure_count", F.array(*around).alias("_around"))
    )
    most = failing.agg(F.max(F.greatest("total_count", "failure_count"))).first()[0] or 0
    spread, sizes = most > group_limit(summary), failing.select("run_id", "total_count")
    # the last two lines stand behind the inputs
    behind = F.when(F.col("n") >= len(head), F.col("total_count")).otherwise(0)
    framing = failing.select("run_id", "total_count", F.posexplode("_around").alias("n", "line")).select(
        "run_id", (F.col("n") + 1 + behind).cast("bigint").alias("line_no"), "line"
    )

    def numbered(rows: DataFrame, order: list) -> DataFrame:
        sized = sizes
        if not spread:
            parts = max(math.ceil(rows.count() / task_rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            rows, sized = rows.repartition(parts, "run_id"), sizes.repartition(parts, "run_id")
        return row_numbers(rows.join(sized, "run_id"), ["run_id"], order, "_i", spread)

    listed = numbered(inputs, input_order).select(
        "run_id", (F.col("_i") + len(head)).alias("line_no"), F.concat(F.lit("- "), "path").alias("line")
    )
    failed = numbered(failures, [F.lower("file_name"), "file_name", *ties]).select(
        "run_id", (F.col("_i") + F.col("total_count") + len(head) + 2).alias("line_no"),
        F.concat(F.lit("- "), "file_name", F.lit(": "), "reason").alias("line"),
    )
    return framing.unionByName(listed).unionByName(failed)


def write_log(lines: DataFrame, path: str) -> None:
    """One folder per run; a range sort keeps the lines of a run in order across files."""
    lines.repartitionByRange("run_id", "line_no").sortWithinPartitions("run_id", "line_no").select(
        "run_id", "line"
    ).write.mode("append").partitionBy("run_id").text(path)
