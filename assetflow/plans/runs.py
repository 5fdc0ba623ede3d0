"""Whole runs on storage: outputs, failures, history, log and folders appear together or not at all.

A run writes its tables below ``<root>/<table>/run_id=.../attempt=...`` and, last of all, one row in ``<root>/commits``.  Readers
only see the attempt that a run's newest commit names: what a stopped run left behind is never read, and a run
that is written again replaces its earlier attempt in one step.  The commits hold a row per run, so they are small beside the tables they
select from, and a semi-join on the partition columns lets Spark skip the folders of all other attempts.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.plans.conversion import StageResult, run_conversion
from assetflow.plans.outcomes import recent_runs
from assetflow.sources import failure_log as logs

# The tables of a run; each also carries run_id and attempt as folders.
TABLES = {
    "outputs": "job_id bigint, asset_id bigint, output_no bigint, path string, strategy string, destination string, output_path string",
    "failures": "job_id bigint, path string, file_name string, reason string",
    "directories": "job_id bigint, folder string",
    "history": "job_id bigint, run_ts timestamp, trigger_source string, output_format string, original_bytes bigint, total_count bigint, "
    "processed_count bigint, success_count bigint, failure_count bigint, was_canceled boolean, duration_ms bigint",
    "log": "job_id bigint, line_no bigint, line string",
}
COMMIT = "run_id string, attempt string, number bigint, committed_at timestamp"
RUN_ID = r"[A-Za-z0-9_.-]+"


class RunStore:
    """Committed runs below ``root``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _stored(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        """``run_id, attempt, number, committed_at`` of the newest commit of every run."""
        # Spark prunes partitions by a join only where the other side is filtered; every commit has a number from 1 on
        every = self._stored("commits", T.StructType.fromDDL(COMMIT)).filter(F.col("number") >= 1)
        newest = F.max(F.struct("number", "committed_at", "attempt")).alias("c")
        return every.groupBy("run_id").agg(newest).select("run_id", "c.attempt", "c.number", "c.committed_at")

    def read(self, name: str, run_id: str | None = None) -> DataFrame:
        """Rows of a table (see ``TABLES``) of all committed runs, or of one, with ``run_id``."""
        schema = T.StructType.fromDDL(f"{TABLES[name]}, run_id string, attempt string")
        rows, commits = self._stored(name, schema), self.commits()
        if run_id is not None:
            rows, commits = rows.filter(F.col("run_id") == run_id), commits.filter(F.col("run_id") == run_id)
        return rows.join(commits.select("run_id", "attempt"), ["run_id", "attempt"], "left_semi").drop("attempt")

    def names(self, but: str | None = None) -> DataFrame:
        """``folder, file_name`` that committed runs gave out, as ``reserved`` of a later one; ``but`` is a run about to be replaced."""
        given = self.read("outputs") if but is None else self.read("outputs").filter(F.col("run_id") != but)
        parts = [F.regexp_extract("destination", p, 1).alias(n) for p, n in ((r"^(.*)/[^/]*$", "folder"), (r"([^/]*)$", "file_name"))]
        return given.select(*parts).distinct()

    def recent(self, n: int = 12) -> DataFrame:
        """The newest ``n`` history rows; rows of one time in order of job, highest first."""
        return recent_runs(self.read("history").withColumn("batch", F.col("run_id")).withColumn("run_id", F.col("job_id")), n)

    def leftovers(self) -> DataFrame:
        """``name, run_id, attempt`` of folders that no reader sees any more, for a clean-up job.  An
        attempt that is being written at this moment is among them."""
        parts = [
            self._stored(n, T.StructType.fromDDL(f"{s}, run_id string, attempt string")).select(F.lit(n).alias("name"), "run_id", "attempt")
            for n, s in TABLES.items()
        ]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.distinct().join(self.commits(), ["run_id", "attempt"], "left_anti").select("name", "run_id", "attempt")

    def begin(self, run_id: str) -> Attempt:
        if not re.fullmatch(RUN_ID, run_id):
            raise ValueError(f"a run is named by letters, digits, '_', '.' and '-': {run_id!r}")
        return Attempt(self, run_id)


class Attempt:
    """One try of a run: its tables are invisible until :meth:`commit`."""

    def __init__(self, store: RunStore, run_id: str):
        self.store, self.run_id, self.attempt = store, run_id, uuid.uuid4().hex

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a table and return its stored rows, so that what follows from them is not planned again."""
        schema = T.StructType.fromDDL(TABLES[name])
        path = f"{self.store.root}/{name}/run_id={self.run_id}/attempt={self.attempt}"
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(path)
        return self.store.spark.read.schema(schema).parquet(path)

    def commit(self) -> None:
        """One file with one row, moved into place when it is whole: the run is there from then on."""
        earlier = self.store.commits().filter(F.col("run_id") == self.run_id).select("number").first()
        number = 1 + (earlier.number if earlier else 0)
        row = (self.run_id, self.attempt, number, datetime.now(timezone.utc))
        self.store.spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.store.root}/commits")


def commit_run(
    store: RunStore,
    run_id: str,
    assets: DataFrame,
    jobs: DataFrame,
    order: list,
    overrides: DataFrame | None = None,
    reserved: DataFrame | None = None,
    stage: StageResult | None = None,
    trigger_source: str = "manual",
    was_canceled: bool = False,
    started: datetime | None = None,
    finished: datetime | None = None,
    labels: dict[str, str] | None = None,
) -> None:
    """Plan all jobs with :func:`run_conversion` and commit what came of them as ``run_id``.

    The log lists the inputs and failures of jobs that had failures.  Jobs without inputs have a history row and no folder.  Times are of the
    call and of the end of planning, where they are not given.
    """
    started = started or datetime.now(timezone.utc)
    run, attempt = run_conversion(assets, jobs, order, overrides, reserved, stage), store.begin(run_id)
    outputs = attempt.write("outputs", run["outputs"])
    failures = attempt.write("failures", run["failures"])
    cut = F.when(F.col("output_path") == F.col("destination"), F.regexp_extract("destination", r"^(.*)/[^/]*$", 1)).otherwise(F.col("destination"))
    attempt.write("directories", outputs.select("job_id", cut.alias("folder")).distinct())
    duration = int(((finished or datetime.now(timezone.utc)) - started).total_seconds() * 1000)
    sizes = assets.groupBy("job_id").agg(F.sum("size_bytes").alias("original_bytes"))
    told = {"run_ts": F.lit(started).cast("timestamp"), "trigger_source": F.lit(trigger_source), "was_canceled": F.lit(was_canceled), "duration_ms": F.lit(duration)}
    history = run["summary"].join(jobs.select("job_id", "output_format"), "job_id").join(sizes, "job_id", "left").na.fill(0, ["original_bytes"])
    history = attempt.write("history", history.withColumns(told))
    named = lambda df: df.withColumnRenamed("job_id", "run_id")  # noqa: E731  the log knows jobs as runs
    options = [c for c in logs.OPTIONS if c in jobs.columns]
    lines = logs.failure_log(named(history.join(jobs.select("job_id", *options), "job_id")), named(assets), named(failures), order, ["path"], labels)
    attempt.write("log", lines.withColumnRenamed("run_id", "job_id"))
    attempt.commit()
