"""Input positions of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.operators.ordered import row_numbers


def batch_index(assets: DataFrame, order: list, keys: list[str] | None = None, name: str = "batch_index") -> DataFrame:
    """Zero-based position of every input within its job; one job may hold most rows."""
    keys = ["job_id"] if keys is None else keys
    return row_numbers(assets, keys, order, name).withColumn(name, F.col(name) - 1)
