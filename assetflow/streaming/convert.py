"""Converting watched files and counting what came of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.functions.options import normalize_options, watch_rules
from assetflow.operators.lookups import lock_skips
from assetflow.plans.conversion import plan_destinations, route
from assetflow.plans.expand import expand_outputs


def plan_watched(ready: DataFrame, profiles: DataFrame, reserved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(outputs, failures)`` of ready assets (with ``job_id`` naming their profile).  Files are converted one by
    one, so numbers do not depend on which files came together."""
    planned = watch_rules(ready.join(normalize_options(profiles), "job_id"))
    routed = lock_skips(route(planned))
    outputs = expand_outputs(plan_destinations(routed, ["asset_id"], reserved, alone=True))
    failures = routed.filter("locked").select("job_id", "asset_id", "file_name", F.col("skip_reason").alias("reason"))
    return outputs, failures


def watch_counters(outcomes: DataFrame, profile: str = "profile_id", at: str = "finished_at", ties: list[str] | None = None) -> DataFrame:
    """Processed and failed totals and the last completion per profile.  Works on a batch
    and, in update mode, on a stream; every aggregate combines partially."""
    rank = F.struct(at, *(ties or ["file_name"]))
    return outcomes.groupBy(profile).agg(
        F.count_if(~F.col("failed")).alias("processed"),
        F.count_if("failed").alias("failures"),
        F.max(at).alias("last_at"),
        F.max_by("file_name", rank).alias("last_item"),
    )


def counters_writer(root: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for :func:`watch_counters` in update mode: the profiles that a micro-batch changed are
    written under its number.  Totals are whole, not differences, so a batch that is written again changes nothing."""

    def handle(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return handle


def current_counters(spark: SparkSession, root: str, schema: str, profile: str = "profile_id") -> DataFrame:
    """The last totals of every profile that :func:`counters_writer` wrote; ``schema`` is that of the counters."""
    every = spark.read.schema(f"{schema}, batch bigint").parquet(root)
    rest = [c for c in every.columns if c not in (profile, "batch")]
    newest = every.groupBy(profile).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(profile, *[F.col(f"_r.{c}").alias(c) for c in rest])


def names_given(spark: SparkSession, root: str, batch_id: int) -> DataFrame | None:
    """``folder, file_name`` of what the batches before ``batch_id`` planned."""
    try:
        earlier = spark.read.parquet(f"{root}/outputs").filter(F.col("batch") < batch_id)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return earlier.select(
        F.regexp_extract("destination", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("destination", r"([^/]*)$", 1).alias("file_name")
    ).distinct()


def converter(profiles: DataFrame, root: str, existing: Callable[[], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: plans the files of a micro-batch and writes outputs,
    failures and a summary below ``root`` under the batch number.  Writing a batch again
    replaces its folder, so a restarted query repeats nothing; a locked file becomes a
    failure row and does not stop the stream.  Names given by earlier batches are taken, and
    so are those that ``existing()`` lists (``folder, file_name``)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        ready = batch.persist()
        try:
            taken = [names_given(batch.sparkSession, root, batch_id), existing() if existing else None]
            taken = [t.select("folder", "file_name") for t in taken if t is not None]
            outputs, failures = plan_watched(ready, profiles, reduce(DataFrame.unionByName, taken) if taken else None)
            summary = (
                ready.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_count"))
                .join(failures.groupBy("job_id").agg(F.count(F.lit(1)).alias("failure_count")), "job_id", "left")
                .na.fill(0, ["failure_count"])
            )
            wanted = outputs.select("job_id", "asset_id", "output_no", "strategy", "destination", "output_name")
            for name, rows in (("outputs", wanted), ("failures", failures), ("history", summary)):
                rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        finally:
            ready.unpersist()

    return handle
