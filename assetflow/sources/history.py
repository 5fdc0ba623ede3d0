"""Run history: append, load newest first, clear.

Rows are JSON lines, one folder a month.  Beside them a manifest says how many rows of which month came with each append,
so that the newest rows are found without opening, or even listing, the months before.  It is written before
the rows are: an append that breaks leaves a count that is too high, never a month that readers do not know of.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.plans.outcomes import recent_runs
from assetflow.schemas import HISTORY
from assetflow.session import freeze

_CORRUPT = "_corrupt"
MANIFEST = "run_month string, rows bigint, newest timestamp_ntz"


def _manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}/_manifest"  # readers of the store pass over names with an underscore


def _counted(runs: DataFrame) -> DataFrame:
    newest = F.max(F.col("run_ts").cast("timestamp_ntz")).alias("newest")
    return runs.filter(F.col("run_month").isNotNull()).groupBy("run_month").agg(F.count(F.lit(1)).alias("rows"), newest)


def _monthly(runs: DataFrame) -> DataFrame:
    return runs.withColumn("run_month", F.date_format("run_ts", "yyyy-MM"))


def append(runs: DataFrame, path: str) -> None:
    """Add runs as JSON lines under one folder per month, in as few files as their size asks for.  A store
    from before there was a manifest gets one first."""
    spark = runs.sparkSession
    if _months(spark, path) is None and _lines(spark, path, runs.schema) is not None:
        refresh(spark, path, runs.schema)
    rows = freeze(_monthly(runs))  # counted and written: the same rows
    _counted(rows).coalesce(1).write.mode("append").json(_manifest_path(path))
    rows.hint("rebalance", "run_month").write.mode("append").partitionBy("run_month").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``run_month, rows, newest`` of every month appended to, as sums of what the appends noted."""
    noted = spark.read.schema(MANIFEST).json(_manifest_path(path))
    return noted.groupBy("run_month").agg(F.sum("rows").alias("rows"), F.max("newest").alias("newest"))


def _months(spark: SparkSession, path: str) -> list[tuple[str, int]] | None:
    """Months, newest first, with their counts: a row a month, twelve a year.  None without a manifest."""
    try:
        rows = manifest(spark, path).orderBy(F.col("run_month").desc()).collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return [(r["run_month"], r["rows"]) for r in rows] or None


def _lines(spark: SparkSession, path: str, schema: T.StructType, months: list[str] | None = None) -> DataFrame | None:
    """Readable rows of the store, or of some of its months; None where there are no such folders."""
    wanted = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    root = path.rstrip("/")
    where = root if months is None else f"{root}/run_month={{{','.join(months)}}}"
    reader = spark.read.schema(wanted).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
    try:
        lines = reader.option("basePath", root).json(where)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return lines.filter(F.col("run_ts").isNotNull() & F.col(_CORRUPT).isNull()).select(*schema.names)


def load(spark: SparkSession, path: str, n: int = 12, schema: T.StructType = HISTORY) -> DataFrame:
    """The newest ``n`` runs; a missing store or unreadable lines give no rows.

    Months are read from the newest on until their readable rows are ``n``: as many as the manifest asks for, and twice as
    many each time lines turn out to be unreadable.  A store without a manifest is read whole; files put into it by other hands
    than :func:`append` count for their month once it is read, see :func:`refresh`.
    """
    months, take = _months(spark, path), 0
    if months is not None:
        found = 0
        while take < len(months) and found < n:
            found, take = found + months[take][1], take + 1
    while months is not None and take < len(months):
        good = _lines(spark, path, schema, [m for m, _ in months[:take]])
        if good is not None and good.limit(n).count() >= n:
            return recent_runs(good, n)
        take = max(1, 2 * take)
    good = _lines(spark, path, schema)
    return spark.createDataFrame([], schema) if good is None else recent_runs(good, n)


def refresh(spark: SparkSession, path: str, schema: T.StructType = HISTORY) -> None:
    """Write the manifest anew from the rows there are."""
    good = _lines(spark, path, schema)
    if good is not None:
        _counted(_monthly(good)).coalesce(1).write.mode("overwrite").json(_manifest_path(path))


def clear(spark: SparkSession, path: str, schema: T.StructType = HISTORY) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").json(path)


def to_json(runs: DataFrame) -> DataFrame:
    return runs.select(F.to_json(F.struct(*HISTORY.names)).alias("line"))


def from_json(lines: DataFrame) -> DataFrame:
    """Rows of stored lines; a line that does not parse is left out."""
    parsed = lines.select(F.from_json("line", HISTORY, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return parsed.filter(F.col("run_id").isNotNull())
