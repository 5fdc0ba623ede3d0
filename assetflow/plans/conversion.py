"""A whole conversion as one plan, and the user-supplied model stage in front of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.functions.content import model_eligible
from assetflow.functions.naming import output_base_name, output_folder
from assetflow.functions.options import is_blank, normalize_options, output_extension
from assetflow.operators.collisions import resolve_collisions
from assetflow.operators.lookups import apply_overrides, exclude_failed, input_overrides, lock_skips
from assetflow.operators.numbering import batch_index
from assetflow.plans.expand import expand_outputs, makes_folder, route_conversion
from assetflow.plans.planning import clamp_selection
from assetflow.session import freeze, ship_package

STAGE = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("output_path", T.StringType()),
    T.StructField("model_used", T.StringType()),
    T.StructField("device_used", T.StringType()),
    T.StructField("error", T.StringType()),
])


class ModelLoadError(RuntimeError):
    """Raised by a model function that cannot load its model: the fallback is tried."""


@dataclass
class StageResult:
    results: DataFrame
    failures: DataFrame
    eligible: DataFrame


ModelFn = Callable[[pd.DataFrame, str, str], Sequence[str]]


def model_stage(
    assets: DataFrame,
    fn: ModelFn,
    jobs: DataFrame | None = None,
    primary: str = "standard",
    fallback: str | None = "general",
    force_cpu: bool = False,
    passes: int = 1,
) -> StageResult:
    """Run ``fn(rows, model, device) -> output paths`` over batches of the eligible rows.

    ``jobs`` has ``job_id, model_stage`` and may have ``resolved_model`` (see ``resolve_model``): only inputs of
    jobs that switched the stage on run, each with its job's model, else with ``primary``.  A batch
    that raises is tried on the CPU and then row by row: a bad row becomes a failure and stops
    nothing else.  A model that cannot load switches to the fallback, a failing GPU run to the CPU, both for the
    rest of the partition.  A second pass feeds the first one's output back.  No partition is held in memory.
    The outcome is checkpointed before it is split in results and failures, so the model runs
    once per row however often they are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replaced: dict[str, str] = {}
        devices = ["cpu"] if force_cpu else ["gpu", "cpu"]

        def attempt(rows: pd.DataFrame, model: str, device: str) -> list[str]:
            out: list[str] = []
            for _ in range(passes):
                name = replaced.get(model, model)
                try:
                    out = list(fn(rows, name, device))
                except ModelLoadError:
                    if fallback is None or name == fallback:
                        raise
                    replaced[model] = fallback
                    out = list(fn(rows, fallback, device))
                rows = rows.assign(path=out)
            return out

        def settle(rows: pd.DataFrame, model: str) -> list[tuple]:
            error = None
            for device in list(devices):
                try:
                    out = attempt(rows, model, device)
                    devices[:] = devices[devices.index(device) :]
                    return [(o, replaced.get(model, model), device, None) for o in out]
                except Exception as problem:  # noqa: BLE001  a bad input must not stop the batch
                    error = problem
            if len(rows) == 1:
                return [(None, None, None, str(error))]
            return [settle(rows.iloc[[i]], model)[0] for i in range(len(rows))]

        for pdf in batches:
            done = pd.DataFrame(index=pdf.index, columns=["output_path", "model_used", "device_used", "error"], dtype=object)
            for model, rows in pdf.groupby("model", sort=True):
                done.loc[rows.index] = settle(rows.drop(columns="model"), model)
            yield pd.concat([pdf[["job_id", "path", "file_name"]], done], axis=1)

    ship_package(assets.sparkSession)
    eligible = assets.filter(model_eligible())
    if jobs is not None:
        own = F.coalesce("resolved_model", F.lit(primary)) if "resolved_model" in jobs.columns else F.lit(primary)
        eligible = eligible.drop("model").join(jobs.filter("model_stage").select("job_id", own.alias("model")), "job_id")
    else:
        eligible = eligible.withColumn("model", F.lit(primary))
    ran = eligible.select("job_id", "path", "file_name", "ext", "width", "height", "model").mapInPandas(run, STAGE)
    ran = freeze(ran)
    return StageResult(
        results=ran.filter(F.col("error").isNull()).select("job_id", "path", "output_path", "model_used", "device_used"),
        failures=ran.filter(F.col("error").isNotNull()).select("job_id", "path", "file_name", F.col("error").alias("reason")),
        eligible=eligible.groupBy("job_id").agg(F.count(F.lit(1)).alias("eligible_inputs")),
    )


def route(plan: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Effective selections and the strategy of every input."""
    empty = {c: F.lit(None).cast("bigint") for c in ("sel_page", "sel_frame", "page_from", "page_to", "frame_from", "frame_to")}
    chosen = apply_overrides(plan, overrides) if overrides is not None else plan.withColumns(empty)
    return clamp_selection(chosen).withColumn("strategy", route_conversion())


def plan_destinations(
    routed: DataFrame, order: list, reserved: DataFrame | None = None, item: str = "asset_id", alone: bool = False
) -> DataFrame:
    """Numbering, base names, folders and collision-free destinations of unlocked inputs.
    A locked document keeps its number but reserves no name.  With ``alone`` every input is a batch of its own:
    its number is the first one, and only its name depends on the others."""
    indexed = batch_index(routed, order).withColumn("seq", F.col("batch_index"))
    if alone:
        indexed = indexed.withColumn("batch_index", F.lit(0).cast("bigint"))
    return resolve_collisions(named_outputs(indexed).filter(~F.col("locked")), reserved, item)


def named_outputs(indexed: DataFrame) -> DataFrame:
    """``folder, base_name, ext_out`` that each numbered input asks for."""
    base = output_base_name()
    return indexed.withColumns({
        "folder": output_folder(),
        "base_name": F.when(makes_folder() & is_blank(base), F.when(F.col("is_pdf"), "PDF").otherwise("GIF")).otherwise(base),
        "ext_out": F.when(makes_folder(), "").otherwise(output_extension()),
    })


def run_conversion(
    assets: DataFrame,
    jobs: DataFrame,
    order: list,
    overrides: DataFrame | None = None,
    reserved: DataFrame | None = None,
    stage: StageResult | None = None,
) -> dict[str, DataFrame]:
    """``outputs`` (one row per file to write), ``failures`` and ``summary`` per job.

    With a model stage, its failures leave the list before numbering, so positions are
    those of the remainder; totals still count every input.
    """
    options = normalize_options(jobs)
    planned = assets.join(options, "job_id")
    rest = planned
    if stage is not None:
        rest = input_overrides(exclude_failed(planned, stage.failures, ["job_id"]), stage.results, ["job_id"])
    routed = lock_skips(route(rest, overrides))
    placed = plan_destinations(routed, order, reserved)
    outputs = expand_outputs(placed).withColumn(
        "output_path",
        F.when(F.col("output_name").isNull(), F.col("destination")).otherwise(
            F.concat("destination", F.lit("/"), "output_name")
        ),
    )
    failures = routed.filter("locked").select("job_id", "path", "file_name", F.col("skip_reason").alias("reason"))
    if stage is not None:
        failures = failures.unionByName(stage.failures)
    totals = planned.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_count"))
    failed = failures.groupBy("job_id").agg(F.count(F.lit(1)).alias("failure_count"))
    summary = (
        jobs.select("job_id").distinct().join(totals, "job_id", "left").join(failed, "job_id", "left")
        .na.fill(0, ["total_count", "failure_count"])
        .withColumn("processed_count", F.col("total_count"))
        .withColumn("success_count", F.col("total_count") - F.col("failure_count"))
    )
    return {"outputs": outputs, "failures": failures, "summary": summary}
