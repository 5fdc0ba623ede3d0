"""Planned outputs on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_plan(outputs: DataFrame, path: str, overwrite: bool = True) -> None:
    """By job and format.  Overwriting replaces only the partitions in ``outputs``.

    Rows are rebalanced by job and format first: small jobs share a task, and the
    partitions of a job with most of the rows are split by size at run time.
    """
    writer = outputs.hint("rebalance", "job_id", "output_format").write.partitionBy("job_id", "output_format")
    if overwrite:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)
